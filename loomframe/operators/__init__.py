"""Table operators: inference, profiling, generation, privacy, rules, relations, validation."""
