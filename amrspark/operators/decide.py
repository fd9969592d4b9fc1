"""From mechanism hits and scores to verdict rows, evidence and report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.functions import text

NAMES = "array<string>"
EVIDENCE = "array<struct<description:string,source:string,category:string>>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _item(description: Column, source: Column, category: str) -> Column:
    return F.struct(
        description.alias("description"),
        source.alias("source"),
        F.lit(category).alias("category"),
    )


def _citation(x: Column) -> Column:
    subclass = F.coalesce(x["drug_subclass"], F.lit("unknown"))
    return F.concat(x["gene"], F.lit(" (AMRFinderPlus Subclass="), subclass, F.lit(")"))


def gate(hits: DataFrame, panel: tuple[str, ...] = fixed.PANEL) -> DataFrame:
    """One row per genome and panel drug: fired, rule, matched names, citations, target.

    Only resistance can be forced. The panel is a literal array, exploded on each genome row.
    """
    qrdr, pmqr = F.col("qrdr"), F.col("pmqr")
    both = F.concat("qrdr", "pmqr")
    nothing = F.slice("qrdr", 1, 0)
    two, mixed = F.size(qrdr) >= 2, (F.size(qrdr) >= 1) & (F.size(pmqr) >= 1)
    cipro = F.when(two, qrdr).when(mixed, both).otherwise(nothing)
    cipro_rule = F.when(two, "qrdr_double_mutation").otherwise("qrdr_plus_pmqr")
    # Rule names are fixed values.
    rules = {
        "meropenem": (F.lit("carbapenemase_present"), F.col("carbapenemase"), True),
        "ceftriaxone": (
            F.lit("esbl_ampc_or_carbapenemase_present"), F.col("cephalosporin"), True,
        ),
        "ciprofloxacin": (cipro_rule, cipro, False),
        "gentamicin": (F.lit("16s_rmtase_present"), F.col("rmtase"), True),
        "trimethoprim-sulfamethoxazole": (
            F.lit("sul_or_dfr_present"), F.concat("sul", "dfr"), False,
        ),
    }
    unknown = (F.lit(None).cast("string"), nothing, False)
    entries = []
    for drug in panel:
        rule, matched, cites = rules.get(drug, unknown)
        entries.append(
            F.struct(
                F.lit(drug).alias("antibiotic"),
                rule.alias("rule"),
                matched.alias("matched"),
                F.lit(cites).alias("cites"),
                F.when(F.lit(drug in rules), F.lit(True)).alias("target_present"),
            )
        )
    rows = hits.select("genome_id", F.inline(F.array(*entries)))
    fired = F.size("matched") > 0
    return rows.select(
        "genome_id",
        "antibiotic",
        fired.alias("gate_fired"),
        F.when(fired, F.col("rule")).alias("rule"),
        F.when(fired, "likely_to_fail").alias("forced_verdict"),
        F.transform("matched", lambda x: x["gene"]).alias("matched_genes"),
        F.when(F.col("cites"), F.transform("matched", _citation))
        .otherwise(_empty(NAMES))
        .alias("subclass_citations"),
        "target_present",
    )


def gate_evidence() -> Column:
    """Evidence items of a fired gate."""
    sources = F.when(F.size("subclass_citations") > 0, F.col("subclass_citations")).otherwise(
        F.transform("matched_genes", lambda g: F.concat(F.lit("AMRFinderPlus call: "), g))
    )
    return F.zip_with(
        "matched_genes",
        sources,
        lambda g, s: _item(
            F.concat(g, F.lit(": called known resistance mechanism ("), F.col("rule"), F.lit(")")),
            s,
            "known_mechanism",
        ),
    )


def contributions(
    present: DataFrame, coefficients: DataFrame, drugs: tuple[str, ...]
) -> DataFrame:
    """(genome, drug, feature, weight) of present features, zero where a model has no weight.

    `present` is (genome_id, feature, value); `coefficients` is (antibiotic, feature,
    coefficient) over the vocabulary.
    """
    weights = coefficients.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("antibiotic", "coefficient"))).alias("_w")
    )
    rows = present.where(F.col("value") != 0).join(weights, "feature", "left")
    pairs = F.array(
        *[
            F.struct(
                F.lit(d).alias("antibiotic"),
                F.coalesce(F.try_element_at("_w", F.lit(d)), F.lit(0.0)).alias("weight"),
            )
            for d in drugs
        ]
    )
    return rows.select("genome_id", "feature", F.inline(pairs))


def top_contributions(contrib: DataFrame, k: int = fixed.TOP_EVIDENCE) -> DataFrame:
    """Per genome and drug: strongest features of either sign, of each sign, and whether any
    present feature points to resistance. Groups are bounded by the vocabulary."""
    order = [F.abs("weight").desc(), F.col("feature").asc()]
    by = ["genome_id", "antibiotic"]
    sign = F.signum("weight")
    ranked = contrib.withColumns(
        {
            "_all": F.row_number().over(Window.partitionBy(*by).orderBy(*order)),
            "_same": F.row_number().over(Window.partitionBy(*by, sign).orderBy(*order)),
        }
    )

    def listed(condition: Column, rank: str) -> Column:
        item = F.struct(F.col(rank).alias("r"), "feature", "weight")
        picked = F.when(condition & (F.col(rank) <= k), item)
        return F.array_sort(F.collect_list(picked))

    return ranked.groupBy(*by).agg(
        F.transform(listed(F.lit(True), "_all"), lambda x: x["feature"]).alias("top_features"),
        listed(F.col("weight") > 0, "_same").alias("drivers"),
        listed(F.col("weight") < 0, "_same").alias("protectors"),
        F.bool_or(F.col("weight") > 0).alias("any_driver"),
    )


def coefficient_ranking(coefficients: DataFrame) -> DataFrame:
    w = Window.partitionBy("antibiotic").orderBy(F.abs("coefficient").desc(), "feature")
    return coefficients.withColumn("rank", F.row_number().over(w))


def evidence_topk(contrib: DataFrame, k: int = fixed.TOP_EVIDENCE) -> DataFrame:
    """Top-k present features per genome, drug and sign of the weight."""
    w = Window.partitionBy("genome_id", "antibiotic", "sign").orderBy(
        F.abs("weight").desc(), "feature"
    )
    signed = contrib.withColumn("sign", F.signum("weight").cast("int"))
    return signed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def linear_scores(
    present: DataFrame,
    coefficients: DataFrame,
    models: DataFrame,
    genomes: DataFrame,
    drugs: tuple[str, ...],
) -> DataFrame:
    """Calibrated resistance probability per genome and trained drug from model tables.

    `models` is one row per drug: intercept, platt_a, platt_b. Scores every genome once.
    Products are summed as decimals of 15 digits, so the order of rows cannot move a score across
    a threshold it equals; only a sum with a product outside their range is left in floating point.
    """
    joined = present.join(coefficients, "feature").select(
        "genome_id", "antibiotic", (F.col("coefficient") * F.col("value")).alias("_x")
    )
    exact = F.col("_x").try_cast("decimal(28,15)")
    whole = F.count(exact) == F.count("_x")
    sums = joined.groupBy("genome_id", "antibiotic").agg(
        F.when(whole, F.sum(exact).cast("double")).otherwise(F.sum("_x")).alias("_dot")
    )
    pairs = genomes.select("genome_id").distinct().withColumn(
        "antibiotic", F.explode(F.array(*[F.lit(d) for d in sorted(drugs)]))
    )
    margin = F.coalesce("_dot", F.lit(0.0)) + F.col("intercept")
    z = F.col("platt_a") * margin + F.col("platt_b")
    return (
        pairs.join(sums, ["genome_id", "antibiotic"], "left")
        .join(models, "antibiotic")
        .select("genome_id", "antibiotic", (1 / (1 + F.exp(-z))).alias("p"))
    )


def compatible(vectors: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, mismatched with a reason) against a one-row registry; a null entry is not checked."""
    row = registry.select("db_version", "schema_version", "engineered_version").first()
    wanted = {c: row[c] for c in ("db_version", "schema_version") if row[c] is not None}
    stale = row["engineered_version"] not in (None, fixed.ENGINEERED_VERSION)
    found = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in wanted.items()]
    found.append(F.lit("engineered_version" if stale else None).cast("string"))
    checked = vectors.withColumn("mismatch", F.coalesce(*found))
    ok = checked.where(F.col("mismatch").isNull()).select(*vectors.columns)
    return ok, checked.where(F.col("mismatch").isNotNull()).select(*vectors.columns, "mismatch")


class CompatibilityError(ValueError):
    """A genome was annotated under another version than the models were trained on."""


def require_compatible(vectors: DataFrame, registry: DataFrame) -> DataFrame:
    ok, bad = compatible(vectors, registry)
    first = bad.select("genome_id", "mismatch").limit(1).collect()
    if first:
        raise CompatibilityError(f"{first[0]['genome_id']}: {first[0]['mismatch']}")
    return ok


def sets_of(p: Column, tau_s: Column, tau_r: Column) -> tuple[Column, Column]:
    """Membership of S and R in the prediction set."""
    return p <= tau_s, (1 - p) <= tau_r


def set_labels(in_s: Column, in_r: Column) -> Column:
    return F.filter(
        F.array(F.when(in_s, "S"), F.when(in_r, "R")), lambda x: x.isNotNull()
    )


def _with_scores(gated: DataFrame, models: DataFrame, scores: DataFrame, tops: DataFrame) -> DataFrame:
    """Gate rows with model, score and contributions; `has_model` where a model is registered."""
    keys = ["genome_id", "antibiotic"]
    rows = gated.join(models.withColumn("has_model", F.lit(True)), "antibiotic", "left")
    rows = rows.join(scores.select(*keys, "p"), keys, "left").join(tops, keys, "left")
    in_s, in_r = sets_of(F.col("p"), F.col("tau_s"), F.col("tau_r"))
    lists = {c: F.coalesce(F.col(c), _empty(dict(tops.dtypes)[c])) for c in ("drivers", "protectors", "top_features")}
    return rows.withColumns(
        {
            **lists,
            "has_model": F.coalesce("has_model", F.lit(False)),
            "any_driver": F.coalesce("any_driver", F.lit(False)),
            "in_s": in_s,
            "in_r": in_r,
        }
    )


def _weight_lines(column: str, direction: str) -> Column:
    return F.transform(
        column,
        lambda x: F.format_string(f"%s (LR weight %+.2f toward {direction})", x["feature"], x["weight"]),
    )


def _around(ends: tuple[str, str], middle: Column) -> Column:
    return F.concat(F.lit(ends[0]), middle, F.lit(ends[1]))


def verdicts(gated: DataFrame, models: DataFrame, scores: DataFrame, tops: DataFrame) -> DataFrame:
    """The verdict table: gate, then model and prediction set, else no call.

    `models` is one row per trained drug: version, alpha, tau_s, tau_r, guarantee.
    `scores` need only hold pairs whose gate is quiet.
    """
    rows = _with_scores(gated, models, scores, tops)
    fired = F.col("gate_fired")
    modelled = ~fired & F.col("has_model")
    novel = modelled & ~F.col("in_s") & ~F.col("in_r")
    verdict = (
        F.when(fired, "likely_to_fail")
        .when(modelled, text.verdict_of_set(F.col("in_s"), F.col("in_r")))
        .otherwise("no_call")
    )
    rows = rows.withColumn("verdict", verdict)
    confidence = (
        F.when(fired, F.lit(fixed.MECHANISM_CONFIDENCE))
        .when(modelled, text.confidence("verdict", "p"))
        .otherwise(F.lit(0.0))
    )
    category = (
        F.when(fired, "known_mechanism")
        .when(modelled & ~novel, "statistical_association")
        .otherwise("no_signal")
    )
    drug, version, p = F.col("antibiotic"), F.col("version"), F.col("p")
    source = F.format_string(fixed.MODEL_SOURCE, version, p)
    caveat = _around(fixed.NO_GUARANTEE, drug)
    absent = _around(fixed.NO_DETERMINANT, drug)
    summary = (
        F.when(
            F.col("verdict") == "likely_to_fail",
            F.format_string(fixed.SAYS_FAIL, p),
        )
        .when(
            F.col("verdict") == "likely_to_work",
            F.format_string(fixed.SAYS_WORK, p),
        )
        .otherwise(
            F.format_string(fixed.SAYS_AMBIGUOUS, F.col("alpha").cast("string"), p)
        )
    )

    def one_if(condition: Column, line: Column) -> Column:
        return F.when(condition, F.array(line)).otherwise(_empty(NAMES))

    fail, work = F.col("verdict") == "likely_to_fail", F.col("verdict") == "likely_to_work"
    lines = F.concat(
        one_if(~F.col("guarantee"), caveat),
        F.when(fail, _weight_lines("drivers", "resistance")).otherwise(_empty(NAMES)),
        F.when(work, _weight_lines("protectors", "susceptibility")).otherwise(_empty(NAMES)),
        one_if(work & ~F.col("any_driver"), absent),
        F.array(summary),
    )
    model_items = F.transform(lines, lambda t: _item(t, source, "statistical_association"))
    ood = F.array(
        _item(
            F.concat(F.lit(fixed.SAYS_NOVEL), F.col("alpha").cast("string")),
            F.concat(F.lit("conformal ("), version, F.lit(")")),
            "no_signal",
        )
    )
    reason = _around(fixed.NO_MODEL, drug)
    if "reason" in gated.columns:
        reason = F.coalesce("reason", reason)
    no_model = F.array(_item(reason, F.lit("predictor/model_registry"), "no_signal"))
    return rows.select(
        "genome_id",
        "antibiotic",
        "verdict",
        confidence.alias("confidence"),
        category.alias("category"),
        F.when(fired, F.col("matched_genes"))
        .when(modelled & ~novel, lines)
        .otherwise(_empty(NAMES))
        .alias("supporting_features"),
        F.when(fired, gate_evidence())
        .when(novel, ood)
        .when(modelled, model_items)
        .otherwise(no_model)
        .cast(EVIDENCE)
        .alias("evidence"),
        "target_present",
        F.when(modelled, set_labels(F.col("in_s"), F.col("in_r"))).alias("set_labels"),
        "gate_fired",
        "rule",
    )


# Evidence wording of each curated mechanism, per drug in citation order (fixed values).
MECHANISM_WORDS = {
    "meropenem": (
        ("carbapenemase", "carbapenemase hydrolysing carbapenems"),
        ("porin", "porin (ompK35/ompK36) disruption reducing carbapenem uptake"),
    ),
    "ceftriaxone": (
        (
            "cephalosporin",
            "ESBL/AmpC or carbapenemase hydrolysing 3rd-generation cephalosporins",
        ),
    ),
    "ciprofloxacin": (
        ("qrdr", "QRDR target-site mutation in gyrA/parC"),
        ("pmqr", "plasmid-mediated quinolone-resistance determinant"),
    ),
    "gentamicin": (
        ("rmtase", "16S rRNA methyltransferase (high-level pan-aminoglycoside resistance)"),
        ("ame", "aminoglycoside-modifying enzyme"),
    ),
    "trimethoprim-sulfamethoxazole": (
        ("sul", "sulfonamide dihydropteroate-synthase bypass (sul)"),
        ("dfr", "trimethoprim dihydrofolate-reductase bypass (dfr)"),
    ),
}


def known_evidence(hits: DataFrame) -> DataFrame:
    """(genome, drug, known_names, known_items): curated hits per drug, a repeated name kept once."""

    def items(mechanism: str, words: str) -> Column:
        return F.transform(
            mechanism,
            lambda x: F.struct(
                x["gene"].alias("name"),
                _item(
                    F.concat(x["gene"], F.lit(f": {words}")),
                    F.when(x["is_amr"], _citation(x)).otherwise(
                        F.concat(x["gene"], F.lit(" (AMRFinderPlus point mutation)"))
                    ),
                    "known_mechanism",
                ).alias("item"),
            ),
        )

    entries = [
        F.struct(
            F.lit(drug).alias("antibiotic"),
            F.concat(*[items(m, w) for m, w in specs]).alias("known"),
        )
        for drug, specs in MECHANISM_WORDS.items()
    ]
    rows = hits.select("genome_id", F.inline(F.array(*entries)))
    names = F.transform("known", lambda x: x["name"])
    unique = F.filter("known", lambda x, i: F.array_position(names, x["name"]) == i + 1)
    return rows.withColumn("known", unique).select(
        "genome_id",
        "antibiotic",
        F.transform("known", lambda x: x["name"]).alias("known_names"),
        F.transform("known", lambda x: x["item"]).alias("known_items"),
    )


def report_rows(gated: DataFrame, known: DataFrame, models: DataFrame, scores: DataFrame, tops: DataFrame) -> DataFrame:
    """Report rows: off panel, too little data, gate, then model, with curated evidence first.

    A drug without a model counts as too little data only where the gate is quiet.
    """
    rows = _with_scores(gated, models, scores, tops).join(known, ["genome_id", "antibiotic"], "left")
    fired = F.col("gate_fired")
    modelled = ~fired & F.col("has_model") & F.col("target_present").isNotNull()
    statistical = F.array_except("top_features", "known_names")
    stat_items = F.transform(
        statistical,
        lambda f: _item(
            F.concat(f, F.lit(fixed.WEIGHTED)),
            F.concat(F.lit("logistic-regression model "), F.coalesce("version", F.lit("unknown"))),
            "statistical_association",
        ),
    )
    rows = rows.withColumns(
        {
            "known_names": F.coalesce("known_names", _empty(NAMES)),
            "known_items": F.coalesce("known_items", _empty(EVIDENCE)).cast(EVIDENCE),
        }
    ).withColumn(
        "verdict",
        F.when(fired, "likely_to_fail")
        .when(modelled, text.verdict_of_set(F.col("in_s"), F.col("in_r")))
        .otherwise("no_call"),
    )
    names = F.when(fired, F.col("known_names")).when(
        modelled, F.concat("known_names", statistical)
    ).otherwise(_empty(NAMES))
    evidence = F.when(fired, F.col("known_items")).when(
        modelled, F.concat("known_items", stat_items.cast(EVIDENCE))
    ).otherwise(_empty(EVIDENCE))
    category = (
        F.when(fired | (modelled & (F.size("known_names") > 0)), "known_mechanism")
        .when(modelled & (F.size("top_features") > 0), "statistical_association")
        .otherwise("no_signal")
    )
    confidence = (
        F.when(fired, F.lit(fixed.MECHANISM_CONFIDENCE))
        .when(modelled, text.confidence("verdict", "p"))
        .otherwise(F.lit(0.0))
    )
    return rows.select(
        "genome_id",
        "antibiotic",
        "verdict",
        confidence.alias("confidence"),
        category.alias("category"),
        names.alias("supporting_features"),
        evidence.alias("evidence"),
        "target_present",
        F.when(modelled, set_labels(F.col("in_s"), F.col("in_r"))).alias("set_labels"),
        "gate_fired",
        "rule",
    )


def reconcile(verdict_rows: DataFrame, report: DataFrame) -> DataFrame:
    """Pairs on which the two paths disagree in verdict, confidence or set; empty when sound."""
    keys = ["genome_id", "antibiotic"]
    right = report.select(
        *keys,
        F.col("verdict").alias("report_verdict"),
        F.col("confidence").alias("report_confidence"),
        F.col("set_labels").alias("report_set"),
    )
    joined = verdict_rows.join(right, keys, "full_outer")
    same = (
        F.col("verdict").eqNullSafe(F.col("report_verdict"))
        & (F.abs(F.col("confidence") - F.col("report_confidence")) <= fixed.COMPARE_TOLERANCE)
        & F.col("set_labels").eqNullSafe(F.col("report_set"))
    )
    return joined.where(~F.coalesce(same, F.lit(False))).select(*keys, "verdict", "report_verdict")


def violations(rows: DataFrame) -> DataFrame:
    """Rows that break an invariant of a verdict row, with the first broken rule."""
    labels = F.col("set_labels")
    expected = text.verdict_of_set(F.array_contains(labels, "S"), F.array_contains(labels, "R"))
    cited = F.transform("evidence", lambda e: e["category"])
    broken = (
        F.when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), "confidence_range")
        .when(labels.isNotNull() & (expected != F.col("verdict")), "verdict_of_set")
        .when(
            (F.col("category") != "no_signal") & (F.size("supporting_features") == 0),
            "category_needs_features",
        )
        .when(
            (F.size("evidence") > 0) & ~F.array_contains(cited, F.col("category")),
            "category_needs_citation",
        )
        .when(F.size(F.array_distinct(labels)) < F.size(labels), "set_repeats")
    )
    if "gate_fired" in rows.columns:
        broken = F.coalesce(
            broken,
            F.when(F.col("gate_fired") != F.col("rule").isNotNull(), "gate_rule_mismatch"),
        )
    if "disclaimer" in rows.columns:
        broken = F.coalesce(
            broken, F.when(F.col("disclaimer") != fixed.DISCLAIMER, "disclaimer_text")
        )
    return rows.withColumn("broken", broken).where(F.col("broken").isNotNull())


def badges(rows: DataFrame) -> DataFrame:
    """Table rows as shown to a reader."""
    return rows.select(
        "genome_id",
        "antibiotic",
        text.lookup(fixed.VERDICT_BADGES, F.col("verdict")).alias("label"),
        text.lookup(fixed.VERDICT_COLORS, F.col("verdict")).alias("color"),
        F.bround(F.col("confidence") * 100, 1).alias("confidence_pct"),
        text.lookup(fixed.EVIDENCE_BADGES, F.col("category")).alias("badge"),
        "target_present",
        F.coalesce("set_labels", _empty(NAMES)).alias("set_labels"),
        F.transform(
            "evidence", lambda e: F.concat(e["description"], F.lit(" — "), e["source"])
        ).alias("evidence_lines"),
    )


def row_text() -> Column:
    """One sentence per verdict row. A marker is never worded as support of a susceptible call."""
    label = text.lookup(fixed.EVIDENCE_WORDS, F.col("category"))
    phrase = (
        F.when(F.col("category") == "no_signal", "no resistance signal detected")
        .when(F.col("verdict") == "likely_to_fail", label)
        .when(
            F.col("verdict") == "likely_to_work",
            F.concat(label, F.lit(" present, but the calibrated model predicts susceptibility")),
        )
        .otherwise(F.concat(label, F.lit(" present; evidence is inconclusive (no-call)")))
    )
    details = F.array_join(F.transform("evidence", lambda e: e["description"]), "; ")
    return F.concat(
        F.col("antibiotic"),
        F.lit(": "),
        text.lookup(fixed.VERDICT_WORDS, F.col("verdict")),
        F.lit(" (confidence "),
        F.bround(F.col("confidence") * 100).cast("int").cast("string"),
        F.lit("%, "),
        phrase,
        F.lit(")."),
        F.when(F.size("evidence") > 0, F.concat(F.lit(" Evidence: "), details, F.lit("."))).otherwise(""),
    )


def panel_order(c: str = "antibiotic") -> Column:
    at = F.array_position(F.array(*[F.lit(d) for d in fixed.PANEL]), F.col(c))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(fixed.PANEL)))


def story(lines: Column) -> Column:
    """The text of a genome from its sorted lines (with the sentence as `t`): header, a line per
    drug, the disclaimer last."""
    header = F.concat(
        F.lit("Genome "), F.col("genome_id"), F.lit(" — per-antibiotic decision support.")
    )
    body = F.transform(lines, lambda x: x["t"])
    return F.array_join(F.concat(F.array(header), body, F.array(F.lit(fixed.DISCLAIMER))), "\n")


def narratives(rows: DataFrame) -> DataFrame:
    """One text per genome: header, a line per drug in panel order, the disclaimer last."""
    line = F.struct(panel_order().alias("o"), "antibiotic", row_text().alias("t"))
    lists = rows.groupBy("genome_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lists.select("genome_id", story(F.col("lines")).alias("narrative"))


def reports(rows: DataFrame) -> DataFrame:
    """One nested report per genome with its narrative, both from one list of its rows."""
    fields = [c for c in rows.columns if c != "genome_id"]
    item = F.struct(panel_order().alias("_o"), "antibiotic", row_text().alias("t"), F.struct(*fields).alias("row"))
    packed = rows.groupBy("genome_id").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    return packed.select(
        "genome_id",
        F.transform("_p", lambda x: x["row"]).alias("predictions"),
        F.lit(fixed.DISCLAIMER).alias("disclaimer"),
        story(F.col("_p")).alias("narrative"),
    )
