"""Personal data in knowledge chunks: fixed patterns, and candidates chosen by boosted trees.

Everything on this path is a DataFrame or SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amrspark.llm.store import store

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN_CHUNKS, ROUNDS, DEPTH = 20_000, 8, 3
_BLOCK = 256

# The contract's patterns. Loops are possessive where what follows cannot take a character back,
# so long runs cost no stack; a match starts at a run's first character or where the last ended.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_VALID_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# Generators of candidates; what they propose may overlap.
PROPOSED = {
    "tight": r"(?:\G|(?<![0-9]))[+(]?+[0-9](?:[().\/-]{0,2}+[0-9])++",
    "loose": r"(?:\G|(?<![0-9]))[+(]?+[0-9](?:[ ().\/-]{0,3}+[0-9])++",
    "address": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?+(?:@|\(at\)|\[at\]) ?+{_DOMAIN}++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?){_DOMAIN}++)*+",
}
FEATURES = (
    "n_digits", "n_chars", "n_groups", "longest", "first", "n_dots", "n_spaces", "n_dashes",
    "n_parens", "plus", "at_sign", "word_before", "word_after", "about_phone", "about_card",
    "about_host", "about_mail", "about_version",
)
_SPAN = "array<struct<start:int,end:int,v:string,before:string,after:string>>"
_PLAIN = "array<struct<kind:string,start:int,end:int>>"


def _find(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """`df` with `name`: the places, in code points, of all matches of `pattern` in _t.

    The texts between matches give the distances. Places are summed up in blocks of 256 matches,
    so a text with very many of them costs no square of their number.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(gate, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)).otherwise(none))
    item = F.transform(
        F.arrays_zip(F.col("_m"), F.slice("_s", 1, F.size("_m")), F.slice("_s", 2, F.size("_m"))),
        lambda x: F.struct(
            F.length(x["1"]).alias("g"),
            F.length(x["_m"]).alias("n"),
            x["_m"].alias("v"),
            F.right(x["1"], F.lit(24)).alias("before"),
            F.left(x["2"], F.lit(1)).alias("after"),
        ),
    )
    df = df.withColumn("_i", item)
    count = F.ceil(F.size("_i") / _BLOCK).cast("int")
    blocks = F.when(
        F.size("_i") > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1), lambda b: F.slice("_i", b * _BLOCK + 1, F.lit(_BLOCK))
        ),
    ).otherwise(F.array().cast("array<array<struct<g:int,n:int,v:string,before:string,after:string>>>"))
    df = df.withColumn("_b", blocks)
    sums = F.transform("_b", lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
    starts = F.aggregate(
        sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    df = df.withColumn("_a", starts)

    def place(block, start):
        zero = F.struct(start.alias("p"), F.array().cast(_SPAN).alias("out"))

        def step(acc, x):
            at = acc["p"] + x["g"]
            span = F.struct(
                at.alias("start"), (at + x["n"]).alias("end"), x["v"].alias("v"),
                x["before"].alias("before"), x["after"].alias("after"),
            )
            return F.struct((at + x["n"]).alias("p"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    placed = F.flatten(F.zip_with("_b", F.slice("_a", 1, F.size("_b")), place))
    return df.withColumn(name, placed).drop("_m", "_s", "_i", "_b", "_a")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(
            i % 2 == 1, F.try_element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int") + 1)
        ).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    """The contract's rule on a match of the kind's pattern."""
    if kind == "ip":
        return v.rlike(_VALID_IP)
    if kind == "card":
        n = F.length(_digits(v))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(v))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _valid_of(kind: str):
    return lambda x: _valid(kind, x["v"])


def _is_base(kind: str, v: Column) -> Column:
    return v.rlike(f"^(?:{BASE[kind]})$") & _valid(kind, v)


def base_spans(chunks: DataFrame) -> DataFrame:
    """chunk_id, _t (the text, null as empty) and an array of spans per kind."""
    df = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("_t"))
    gates = {
        "email": F.contains("_t", F.lit("@")),
        "ip": F.col("_t").rlike(r"[0-9]\.[0-9]"),
        "card": F.col("_t").rlike("[0-9][ -]?[0-9]"),
        "phone": F.col("_t").rlike(r"\+[0-9]"),
    }
    for kind in KINDS:
        df = _find(df, f"_{kind}", BASE[kind], gates[kind])
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", _valid_of(kind)))
    return df


def _candidates(df: DataFrame) -> DataFrame:
    """`df` with _c: the proposed spans with their features."""
    df = _find(df, "_tight", PROPOSED["tight"], F.col("_t").rlike("[0-9][().\\/-]{0,2}[0-9]"))
    df = _find(df, "_loose", PROPOSED["loose"], F.col("_t").rlike("[0-9] [+(]?[0-9]"))
    df = _find(df, "_address", PROPOSED["address"], F.col("_t").rlike(r"@|\(at\)|\[at\]"))
    long_enough = F.filter(F.concat("_tight", "_loose"), lambda x: F.length(_digits(x["v"])) >= 7)
    each = F.transform(F.array_distinct(F.concat(long_enough, F.col("_address"))), _features)
    return df.withColumn("_c", each).drop("_tight", "_loose", "_address")


def _features(x: Column) -> Column:
    v, before = x["v"], F.lower(x["before"])
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    lengths = F.transform(groups, lambda g: F.length(g))

    def count(chars: str) -> Column:
        return F.length(v) - F.length(F.translate(v, chars, ""))

    def about(words: str) -> Column:
        return before.rlike(rf"\b(?:{words})\b").cast("int")

    values = {
        "n_digits": F.length(_digits(v)),
        "n_chars": F.length(v),
        "n_groups": F.size(groups),
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "first": F.coalesce(F.try_element_at(lengths, F.lit(1)), F.lit(0)),
        "n_dots": count("."),
        "n_spaces": count(" "),
        "n_dashes": count("-"),
        "n_parens": count("()"),
        "plus": v.startswith("+").cast("int"),
        "at_sign": F.contains(v, F.lit("@")).cast("int"),
        "word_before": x["before"].rlike(r"[\p{L}\p{N}]$").cast("int"),
        "word_after": x["after"].rlike(r"[\p{L}\p{N}]").cast("int"),
        "about_phone": about("tel|phone|call|fax|mobile|cell"),
        "about_card": about("card|visa|mastercard|account|iban|payment"),
        "about_host": about("ip|host|server|address|addr"),
        "about_mail": about("mail|email|contact|write"),
        "about_version": about("version|v|release|section|chapter|license|figure|table"),
    }
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), v.alias("v"),
        *[values[name].cast("double").alias(name) for name in FEATURES],
    )


@dataclass
class KindModel:
    """Boosted trees as an expression, and the line that calibrates their margin."""

    trees: list[tuple[float, object]]
    slope: float
    shift: float

    def chance(self, c: Column) -> Column:
        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + float(weight) * _tree(root, c)
        return 1 / (1 + F.exp(-(float(self.slope) * margin + float(self.shift))))


def _tree(node, c: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    index, threshold, left, right = node
    return F.when(c[FEATURES[index]] <= float(threshold), _tree(left, c)).otherwise(_tree(right, c))


def _plain(node):
    if node.getClass().getSimpleName() != "InternalNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _plain(node.leftChild()), _plain(node.rightChild())


def fit_kinds(chunks: DataFrame, max_train_chunks: int = MAX_TRAIN_CHUNKS, seed: int = 5) -> dict[str, KindModel]:
    """A model per kind, learnt from the chunks themselves.

    A candidate that fits a kind's fixed pattern and rule is an example of it, all others are
    counter-examples; the features do not hold the rule's check digit, so the model learns what
    such data looks like. Half of the rows, by a hash, calibrate the margins. About
    `max_train_chunks` chunks are read, taken by a hash of their text. A kind without both sorts
    of examples has no model.
    """
    share = min(1.0, max_train_chunks / max(1, chunks.count()))
    some = chunks.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    df = some.select(F.lit(0).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("_t"))
    # An inner explode would push a filter on _c, and with it all its expressions, below the sample.
    rows = _candidates(df).select(F.explode_outer("_c").alias("c")).where(F.col("c").isNotNull())
    rows = rows.select("c.*").withColumns({f"is_{k}": _is_base(k, F.col("v")).cast("double") for k in KINDS})
    rows = rows.withColumn("part", F.pmod(F.xxhash64("v", "start"), F.lit(2))).drop("v")
    rows = store(rows, "candidates")
    put = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    counts = rows.groupBy("part").agg(
        *[F.sum(f"is_{k}").alias(k) for k in KINDS], F.count("*").alias("n")
    ).collect()
    models = {}
    for kind in KINDS:
        if len(counts) < 2 or any(r[kind] in (0, r["n"]) for r in counts):
            continue
        data = put.transform(rows.withColumn("label", F.col(f"is_{kind}")))
        learner = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.5, seed=seed, minInstancesPerNode=5)
        fitted = learner.fit(data.where("part = 0"))
        trees = [
            (w, _plain(t._call_java("rootNode")))
            for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)
        ]
        raw = KindModel(trees, 1.0, 0.0)
        margin = F.lit(0.0)
        c = F.struct(*FEATURES)
        for weight, root in raw.trees:
            margin = margin + float(weight) * _tree(root, c)
        held = rows.where("part = 1").select(F.col(f"is_{kind}").alias("label"), margin.alias("margin"))
        held = VectorAssembler(inputCols=["margin"], outputCol="features").transform(held)
        line = LogisticRegression(regParam=1e-4, maxIter=50).fit(held)
        models[kind] = KindModel(trees, float(line.coefficients[0]), float(line.intercept))
    return models


def find_private(
    chunks: DataFrame,
    models: dict[str, KindModel] | None = None,
    *,
    threshold: float = 0.5,
    max_train_chunks: int = MAX_TRAIN_CHUNKS,
) -> DataFrame:
    """Spans of personal data in every chunk's whole text.

    Parameters
    ----------
    chunks: chunk_id, text; others are ignored.
    models: of `fit_kinds`; by default fitted here.
    threshold: calibrated chance from which a candidate is taken.

    Returns one row per chunk row: chunk_id, text, base and spans. Both are arrays of (kind,
    start, end) in code points, end exclusive, ordered by kind as in KINDS, then start. base
    holds the fixed patterns' matches: leftmost, non-overlapping per kind, valid. spans adds the
    candidates of the generators whose kind's chance reaches the threshold, most likely kind
    first, where they meet no base span and no earlier added one.

    Null and empty texts have no spans. Repeated rows are judged each, ids may be null, an empty
    table gives no rows.
    """
    given = chunks.select("chunk_id", "text")
    if models is None:
        models = fit_kinds(given, max_train_chunks)
    df = base_spans(given.withColumn("_own", F.col("text")).select("chunk_id", F.col("_own").alias("text")))

    def named(kind: str) -> Column:
        return F.transform(
            f"_{kind}",
            lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
        )

    df = df.withColumn("base", F.concat(*[named(k) for k in KINDS]).cast(_PLAIN)).drop(*[f"_{k}" for k in KINDS])
    df = _candidates(df)

    def told(c: Column) -> Column:
        chances = [
            F.struct(
                models[k].chance(c).alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("kind"),
                c["start"].alias("start"), c["end"].alias("end"),
            )
            for i, k in enumerate(KINDS)
            if k in models
        ]
        return F.array_max(F.array(*chances))

    if models:
        free = F.filter(
            "_c",
            lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
        )
        likely = F.filter(F.transform(free, told), lambda x: x["p"] >= threshold)
        df = df.withColumn("_l", F.array_sort(likely, _by_place))
        zero = F.struct(F.lit(0).alias("p"), F.array().cast(_PLAIN).alias("out"))

        def take(acc, x):
            span = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
            fits = x["start"] >= acc["p"]
            return F.struct(
                F.when(fits, x["end"]).otherwise(acc["p"]).alias("p"),
                F.when(fits, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
            )

        added = F.aggregate("_l", zero, take, lambda acc: acc["out"])
    else:
        added = F.array().cast(_PLAIN)
    df = df.withColumn("_all", F.concat("base", added))
    ordered = F.concat(
        *[
            F.array_sort(F.filter("_all", of_kind(k))) for k in KINDS
        ]
    )
    return df.select("chunk_id", F.col("_t").alias("text"), "base", ordered.alias("spans"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _by_place(x: Column, y: Column) -> Column:
    """Earlier start first, then the longer, then the likelier."""
    return (
        F.when(x["start"] != y["start"], x["start"] - y["start"])
        .when(x["end"] != y["end"], y["end"] - x["end"])
        .when(x["p"] != y["p"], F.when(x["p"] > y["p"], -1).otherwise(1))
        .otherwise(y["o"] - x["o"])
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def redact(found: DataFrame) -> DataFrame:
    """`found` with clean_text: each stretch of spans replaced by its first kind in brackets."""
    order = F.array_sort(
        F.transform(F.col("spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    )
    df = found.withColumn("_o", order)
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        piece = F.concat(
            F.substring(F.col("text"), acc["p"] + 1, x["start"] - acc["p"]), F.lit("["), F.upper(x["kind"]), F.lit("]")
        )
        return F.struct(
            F.greatest(acc["p"], x["end"]).alias("p"),
            F.when(x["start"] >= acc["p"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate("_o", zero, step)
    df = df.withColumn("_d", done)
    tail = F.substring(F.col("text"), F.col("_d.p") + 1, F.length("text"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join("_d.out", ""), tail)).otherwise(F.col("text"))
    return df.withColumn("clean_text", clean).drop("_o", "_d")
