"""Per-batch checks and admission control on streams."""
