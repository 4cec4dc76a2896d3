"""Train on synthetic, test on real: does a model learnt from synthetic rows work on real ones?"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.dates import date_evidence, read_date
from ..functions.stats import running_totals
from ..functions.stored import stored
from .infer import ColumnSpec
from .profile import numeric_view, order_statistics, top_values, value_counts


def split(df: DataFrame, key: str, seed: int, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a draw from their key: the same under any partitioning, without a shuffle."""
    u = rng.uniform(seed, "split", F.col(key))
    return df.where(u < share), df.where(u >= share)


def split_exact(df: DataFrame, key: str, seed: int, train: int) -> DataFrame:
    """Rows with `train`: whether they are among the `train` smallest draws."""
    drawn = df.withColumn("_u", rng.uniform(seed, "split", F.col(key)))
    first = drawn.select("_u", key).orderBy("_u", key).limit(train).select(key, F.lit(True).alias("train"))
    return drawn.join(first, key, "left").withColumn("train", F.coalesce("train", F.lit(False))).drop("_u")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the curve with ties at their average rank. Equal scores are counted first, then summed by ranges."""
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    ranked = running_totals(counts, "s", ["n"]).withColumn("rank", F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"))


def accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row: F1 averaged over the classes among the labels."""
    confusion = df.groupBy(F.col(label).cast("string").alias("l"), F.col(predicted).cast("string").alias("p")).count()
    side = confusion.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit(1).alias("real")), F.struct(F.col("p").alias("c"), F.lit(0).alias("real")))).alias("x"), "count", (F.col("l") == F.col("p")).alias("hit"))
    each = side.groupBy("x.c").agg(F.sum(F.when(F.col("hit") & (F.col("x.real") == 1), F.col("count")).otherwise(0)).alias("tp"), F.sum("count").alias("both"), F.sum(F.when(F.col("x.real") == 1, F.col("count")).otherwise(0)).alias("n"))
    return each.where("n > 0").agg(F.avg(2.0 * F.col("tp") / F.col("both")).alias("macro_f1"))


def regression(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """One row: r2 and mae."""
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    return df.agg((1 - F.sum((y - p) * (y - p)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg(F.abs(y - p)).alias("mae"))


def utility(real: float, synthetic: float, base: float) -> float | None:
    """How much of the real model's skill above the baseline the synthetic one keeps; None where there is no skill to keep."""
    return None if real - base < 0.05 else max(0.0, min(1.0, (synthetic - base) / (real - base)))


def rating(score: float) -> str:
    return "excellent" if score >= 0.9 else "good" if score >= 0.75 else "fair" if score >= 0.5 else "poor"


def forest_scores(train: DataFrame, test: DataFrame, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """(key columns of test, label, score): a random forest of 25 trees on numeric features, nulls as -1 with their own flag."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def ready(df: DataFrame) -> DataFrame:
        cols: list[Column] = []
        for f in features:
            cols += [F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f"x_{f}"), F.col(f).isNull().cast("double").alias(f"m_{f}")]
        return df.select(F.col(label).cast("double").alias("label"), *cols)

    names = [n for f in features for n in (f"x_{f}", f"m_{f}")]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = RandomForestClassifier(numTrees=25, maxDepth=10, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed).fit(assemble.transform(ready(train)))
    return model.transform(assemble.transform(ready(test))).select("label", vector_to_array("probability")[1].alias("score"))


#: Shares of the rows of one combination of features that a forest draws by themselves.
SHARES = 256


def condensed(df: DataFrame, features: list[str], label: str, regression: bool) -> DataFrame:
    """Weighted rows (features, label, _w) that all splits of a tree measure as they measure the rows themselves.

    Rows of equal features are dealt to `SHARES` shares. A class's rows in a share become one with their number as weight; numbers become
    two, at the mean plus and minus the deviation, which keep count, sum and sum of squares. So every row counts, a forest's passes do not grow
    with the table once all combinations are full, and a forest still draws its trees' rows by share, by row where a share has one.
    """
    plain = df.select(*[F.col(c).alias(c, metadata={}) for c in features], label)  # what the codes mean is of no use here
    dealt = plain.withColumn("_share", F.monotonically_increasing_id() % SHARES)
    if not regression:
        return dealt.groupBy(*features, label, "_share").agg(F.count("*").cast("double").alias("_w")).drop("_share")
    y = F.col(label)
    sums = dealt.groupBy(*features, "_share").agg(F.count("*").cast("double").alias("_n"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_off"))
    apart = F.array(F.struct((F.col("_mean") - F.col("_off")).alias(label), (F.col("_n") / 2).alias("_w")), F.struct((F.col("_mean") + F.col("_off")).alias(label), (F.col("_n") / 2).alias("_w")))
    one = F.array(F.struct(F.col("_mean").alias(label), F.col("_n").alias("_w")))
    return sums.select(*features, F.inline(F.when(F.col("_off") > 0, apart).otherwise(one)))


def _coded(c: str, n: int) -> Column:
    """A column of codes below n, named as a class."""
    return F.col(c).alias(c, metadata={"ml_attr": {"type": "nominal", "vals": [str(k) for k in range(n)]}})


def _by_vector(df: DataFrame, model, assemble, features: list[str], out: list[str]) -> DataFrame:
    """The rows with a model's output columns, worked out once for each combination of features."""
    found = model.transform(assemble.transform(df.select(*features).distinct())).select(*features, *out)
    return df.join(found, features)


def forest_values(train: DataFrame, test: DataFrame, numbers: list[str], categories: list[str], label: str, regression: bool = False, seed: int = 1, most: int = 32) -> DataFrame:
    """(label, predicted) of the test rows by a forest of 25 trees on numbers and categories, for a number or, by its text, a class.

    Categories are lower-cased and trimmed and get codes shared by both tables; those beyond the `most` - 2 most frequent ones
    share the code of unknown ones, and nulls have one of their own. Null numbers are -1 with a flag.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    key = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("\x00"))
    frequent: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        both = train.select(*categories).unionByName(test.select(*categories))
        for r in top_values(both.select(*[key(c).alias(c) for c in categories]), categories, most - 2).orderBy("column", "rank").collect():
            frequent[r["column"]].append(r["value"])

    def ready(df: DataFrame) -> DataFrame:
        cols = [F.col(label).cast("double" if regression else "string").alias("_label")]
        for c in numbers:
            cols += [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"x_{c}"), F.col(c).isNull().cast("double").alias(f"m_{c}")]
        cols += [F.when(key(c).isin(*frequent[c]), key(c)).otherwise("\x01").alias(f"c_{c}") for c in categories]
        return df.where(F.col(label).isNotNull()).select(*cols)

    train, test = ready(train), ready(test)
    names = [n for c in numbers for n in (f"x_{c}", f"m_{c}")]
    if categories:
        codes = StringIndexerModel.from_arrays_of_labels([[*frequent[c], "\x01"] for c in categories], [f"c_{c}" for c in categories], [f"k_{c}" for c in categories])
        train, test, names = codes.transform(train), codes.transform(test), names + [f"k_{c}" for c in categories]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    setting = {"numTrees": 25, "maxDepth": 10, "minInstancesPerNode": 3, "maxBins": most, "weightCol": "_w", "seed": seed}
    own = stored(condensed(train, names, "_label", regression), "condensed")
    # Codes are named as classes, so that trees split them by sets of values.
    own = own.select(*[_coded(c, len(frequent[c[2:]]) + 1) if c.startswith("k_") else F.col(c) for c in names], "_label", "_w")
    if regression:
        model = RandomForestRegressor(labelCol="_label", featureSubsetStrategy="onethird", **setting).fit(assemble.transform(own))
        return _by_vector(test, model, assemble, names, ["prediction"]).select(F.col("_label").alias("label"), F.col("prediction").alias("predicted"))
    classes = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(own)
    model = RandomForestClassifier(labelCol="_y", featureSubsetStrategy="sqrt", **setting).fit(assemble.transform(classes.transform(own)))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=classes.labels).transform(_by_vector(test, model, assemble, names, ["prediction"]))
    return named.select(F.col("_label").alias("label"), "predicted")


def predictable(kind: str, real: float, base: float = 0.0) -> bool:
    """Whether the real model has skill worth comparing: auc (binary), r2 (regression) or accuracy above the baseline."""
    return real >= 0.6 if kind == "auc" else real >= 0.1 if kind == "r2" else real - base >= 0.05


@dataclass(frozen=True)
class Target:
    """A column that a model could predict: `task` is binary, classes or regression; `score` says how likely a person would pick it."""

    column: str
    task: str
    score: float
    reasons: tuple[str, ...]


#: Most classes of a target, and fewest rows of each and of all.
MOST_CLASSES, LEAST_ROWS = 20, 50


def targets(specs: list[ColumnSpec], facts: dict[str, dict]) -> tuple[list[Target], dict[str, str]]:
    """Columns that can be targets, the likeliest first, and why each other one can't be.

    facts: for each column n_rows, n (not null), n_distinct and `least`, the rows of its rarest value. What speaks for a column is found in its
    values and its place: two values are an outcome more often than a trait, an uneven share of them more often still, and what
    is decided last tends to stand last in a table; a number is rather measured than decided, a class with many values rather a label.
    """
    good, out = [], {}
    for i, s in enumerate(specs):
        f = facts[s.name]
        why = (
            "identifies rows" if s.kind == "identifier" or s.semantic == "Identifier" else "personal" if s.privacy == "high" else "free text" if s.kind == "text" else "a date" if s.kind == "datetime"
            else "one value" if f["n_distinct"] < 2 else "too few rows" if f["n"] < LEAST_ROWS else "too many classes" if s.kind != "numeric" and f["n_distinct"] > MOST_CLASSES else None
        )
        if why:
            out[s.name] = why
            continue
        numeric = s.kind == "numeric" and f["n_distinct"] > 2
        task = "regression" if numeric else "binary" if f["n_distinct"] == 2 else "classes"
        place = (i + 1) / len(specs)
        steps = [
            (3.0, "two values", task == "binary"), (1.0, "a yes or a no", s.kind == "boolean"), (1.0, "one of them is rarer", task == "binary" and f["least"] / f["n"] < 0.4), (1.5, "a few classes", task == "classes" and f["n_distinct"] <= 6),
            (0.5, "a number", numeric), (place, "stands late in the table", place > 0.5), (-1.0, "a trait of people or places", s.semantic in ("Age", "City", "Country", "Address")), (-1.0, "often missing", f["n"] < 0.8 * f["n_rows"]),
        ]
        hold = [(x, why) for x, why, holds in steps if holds]
        good.append(Target(s.name, task, round(sum(x for x, _ in hold), 3), tuple(w for _, w in hold)))
    return sorted(good, key=lambda t: (-t.score, t.column)), out


def target_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """n_rows, n, n_distinct and the rows of the rarest value of each column: a row a column."""
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])))
    found = values.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count("v").alias("n_distinct"), F.min(F.when(F.col("v").isNotNull(), F.col("n"))).alias("least"),
    )
    return {r["column"]: r.asDict() for r in found.collect()}


BINS, MOST_CATEGORIES = 32, 30


@dataclass(frozen=True)
class Encoder:
    """Cuts of numbers and codes of categories, learnt from the training rows and used for all tables."""

    cuts: dict[str, list[float]]
    codes: dict[str, list[str]]


def encoder(train: DataFrame, numbers: list[str], categories: list[str], bins: int = BINS) -> Encoder:
    """Exact quantiles of the numbers, and the most frequent categories."""
    cuts: dict[str, list[float]] = {c: [] for c in numbers}
    if numbers:
        for r in order_statistics(value_counts(train, numbers), [i / bins for i in range(1, bins)]).orderBy("column", "k").collect():  # `bins` rows a column
            if not cuts[r["column"]] or cuts[r["column"]][-1] < r["q"]:
                cuts[r["column"]].append(r["q"])
    codes: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        for r in top_values(train.select(*[_key(c).alias(c) for c in categories]), categories, MOST_CATEGORIES).orderBy("column", "rank").collect():
            codes[r["column"]].append(r["value"])
    return Encoder(cuts, codes)


def _key(c: str) -> Column:
    return F.lower(F.trim(F.col(f"`{c}`").cast("string")))


def encoded(df: DataFrame, e: Encoder, label: Column) -> DataFrame:
    """_label and a column for each feature: a number's bin from 1, a category's code from 2; 0 for null, 1 for a category not known."""
    columns = [label.alias("_label")]
    for c, cuts in e.cuts.items():
        x = F.col(f"`{c}`").cast("double")
        bin_ = F.lit(1.0)
        for q in cuts:
            bin_ = bin_ + (x >= F.lit(float(q))).cast("double")
        columns.append(F.when(x.isNull() | F.isnan(x), 0.0).otherwise(bin_).alias(f"b_{c}"))
    for c, values in e.codes.items():
        code = F.when(_key(c).isNull(), 0.0)
        for k, v in enumerate(values):
            code = code.when(_key(c) == v, float(k + 2))
        columns.append(code.otherwise(1.0).alias(f"c_{c}"))
    return df.select(*columns).where("_label IS NOT NULL")


def _forest(train: DataFrame, test: DataFrame, task: str, seed: int, sizes: dict[str, int]) -> DataFrame:
    """(label, predicted, score) of encoded test rows; `sizes` is how many codes a class column has; labels are numbers, score is the chance of label 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    names = [c for c in train.columns if c != "_label"]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    setting = {"labelCol": "_label", "weightCol": "_w", "numTrees": 25, "maxDepth": 10, "minInstancesPerNode": 3, "maxBins": max(BINS, MOST_CATEGORIES) + 2, "seed": seed}
    own = stored(condensed(train, names, "_label", task == "regression"), "condensed")
    own = assemble.transform(own.select(*[_coded(c, sizes[c]) if c in sizes else F.col(c) for c in names], "_label", "_w"))
    if task == "regression":
        model = RandomForestRegressor(featureSubsetStrategy="onethird", **setting).fit(own)
        return _by_vector(test, model, assemble, names, ["prediction"]).select(F.col("_label").alias("label"), F.col("prediction").alias("predicted"), F.lit(None).cast("double").alias("score"))
    model = RandomForestClassifier(featureSubsetStrategy="sqrt", **setting).fit(own)
    out = _by_vector(test, model, assemble, names, ["prediction", "probability"])
    return out.select(F.col("_label").alias("label"), F.col("prediction").alias("predicted"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


@dataclass(frozen=True)
class Comparison:
    """What a model learnt from synthetic rows is worth, next to one learnt from real ones; utility is None where real rows show no skill."""

    target: str
    task: str
    metric: str
    base: float
    real: float
    synthetic: float
    utility: float | None
    rating: str
    features: tuple[str, ...]
    excluded: dict[str, str]
    n_train: int
    n_test: int


def _rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as a table of their own: they are read many times, and whatever they are worked out from only once."""
    kinds = dict(df.dtypes)
    return stored(df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kinds[c] == "void" else F.col(f"`{c}`") for c in columns]), "rows")  # Parquet has no void


def _dated(df: DataFrame, specs: list[ColumnSpec]) -> tuple[DataFrame, list[ColumnSpec]]:
    """Texts of date columns read as dates, the day first where their values show it; null for what is none."""
    texts = [s.name for s in specs if s.kind == "datetime" and dict(df.dtypes)[s.name] == "string"]
    if not texts:
        return df, specs
    first = {c: bool(date_evidence(df, f"`{c}`").first()["day_first"]) for c in texts}
    read = df.select(*[read_date(F.col(f"`{c}`"), first[c]).alias(c) if c in first else F.col(f"`{c}`") for c in df.columns])
    return stored(read, "dated"), [replace(s, type=s.type if s.type == "date" else "datetime") if s.name in first else s for s in specs]


def tstr(df: DataFrame, specs: list[ColumnSpec], key: str, seed: int, target: str | None = None) -> Comparison:
    """Train on synthetic, test on real. A quarter of the rows, by a draw from their key, is left aside: the generator and both models learn from
    the rest only, and so do the bins and codes that all three tables share. Without `target` the likeliest one is taken. Dates speak as the numbers
    that they count; of the columns that can't be targets, only what identifies, is personal, hidden, free text or has too many categories is no feature."""
    from . import generate as G

    df, specs = _dated(_rows(df, list(dict.fromkeys([key, *[s.name for s in specs]]))), specs)
    facts = target_facts(df, [s.name for s in specs])
    found, why = targets(specs, facts)
    if target is None and not found:
        raise ValueError(f"no column can be predicted: {why}")
    goal = next((t for t in found if t.column == target), None) if target else found[0]
    if goal is None:
        raise ValueError(f"{target} can't be predicted: {why.get(target, 'not a column')}")
    kinds = {s.name: s for s in specs}
    hidden = {s.name: f"its values are {s.transform}ed" for s in specs if s.transform in ("mask", "hash")}
    as_feature = {n for n, x in why.items() if x in ("a date", "one value", "too few rows") or (x == "too many classes" and facts[n]["n_distinct"] <= MOST_CATEGORIES)}
    left_out = {n: x for n, x in {**why, **hidden}.items() if n not in as_feature or n in hidden}
    usable = [s.name for s in specs if s.name not in left_out and s.name != goal.column]
    dates = [c for c in usable if kinds[c].kind == "datetime"]
    numbers, categories = [c for c in usable if kinds[c].kind in ("numeric", "datetime")], [c for c in usable if kinds[c].kind not in ("numeric", "datetime")]
    counted = lambda rows: rows.withColumns({c: numeric_view(F.col(f"`{c}`"), kinds[c].type) for c in dates}) if dates else rows
    train, test = split(df, key, seed)
    wanted = [s for s in specs if s.name in (*usable, goal.column)]
    n_train, n_test = train.count(), test.count()
    made = G.cells(df.sparkSession, wanted, n_train, seed, G.learn(train, wanted))
    e = encoder(counted(train), numbers, categories)
    if goal.task == "regression":
        label = F.col(f"`{goal.column}`").cast("double")
    else:
        classes = [r[0] for r in train.select(_key(goal.column).alias("v")).where("v IS NOT NULL").groupBy("v").count().orderBy("v").limit(MOST_CLASSES).collect()]
        label = F.lit(None).cast("double")
        for k, v in enumerate(classes):
            label = F.when(_key(goal.column) == v, float(k)).otherwise(label)
    real, ready = stored(encoded(counted(train), e, label), "train"), stored(encoded(counted(test), e, label), "test")
    metric = {"binary": "auc", "classes": "accuracy", "regression": "r2"}[goal.task]
    base = {"auc": 0.5, "r2": 0.0}.get(metric)
    if base is None:
        share = real.groupBy("_label").count().agg((F.max("count") / F.sum("count")).alias("x")).first()
        base = share["x"] or 0.0

    def score(rows: DataFrame) -> float:
        out = stored(_forest(rows, ready, goal.task, seed, {f"c_{c}": len(v) + 2 for c, v in e.codes.items()}), "predictions")
        if metric == "auc":
            return auc(out, "score", "label").first()["auc"] or 0.5
        if metric == "accuracy":
            return accuracy(out, "predicted", "label").first()["accuracy"] or 0.0
        return regression(out, "predicted", "label").first()["r2"] or 0.0

    on_real, on_made = score(real), score(encoded(counted(made), e, label))
    worth = utility(on_real, on_made, base) if predictable(metric, on_real, base) else None
    return Comparison(goal.column, goal.task, metric, base, on_real, on_made, worth, "n/a" if worth is None else rating(worth), tuple(usable), left_out, n_train, n_test)


def latest(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
