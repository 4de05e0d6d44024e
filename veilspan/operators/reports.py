"""Audit, metrics, evaluation, vault: aggregates over findings, decisions and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_events(inspected: DataFrame, key: str = "doc_id", evidence: bool = True, named_rules: bool = True) -> DataFrame:
    """(key, decision_count, blocked, audit_event JSON); values are replaced by their length.

    `evidence`: findings stand in the event; `named_rules`: action, rule and severity do.
    """
    safe = F.transform(
        "findings",
        lambda x: F.struct(
            *([x["decision"]["action"].alias("action"), x["decision"]["rule_id"].alias("rule_id"), x["decision"]["severity"].alias("severity")] if named_rules else []),
            *([F.struct(x["span"]["entity"].alias("entity"), x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["span"]["confidence"].alias("confidence"), x["span"]["detector_id"].alias("detector_id"), F.concat(F.lit("[REDACTED len="), F.length(x["span"]["value"]), F.lit("]")).alias("value")).alias("finding")] if evidence else [x["span"]["entity"].alias("entity")]),
        ),
    )
    n = F.coalesce(F.size("findings"), F.lit(0))
    reask = F.coalesce(F.exists("findings", lambda x: F.coalesce(x["decision"]["on_fail"] == "reask", F.lit(False))), F.lit(False))
    return inspected.select(key, n.cast("long").alias("decision_count"), "blocked", F.to_json(F.struct(n.alias("decision_count"), "blocked", reask.alias("reask_hint"), safe.alias("decisions"))).alias("audit_event"))


def audit_summary(decisions: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): counts along each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return decisions.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def export_sets(decisions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each key, the sorted distinct values of each column."""
    return decisions.groupBy(key).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def durations(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n, min, p50, p95, max, avg); a percentile p is the value at index round((n-1)p), half to even.

    Values are counted first, so a window runs over the distinct values of a name, not over its rows.
    """
    from pyspark.sql import Window as W

    counted = metrics.where(F.col(value).isNotNull()).groupBy(F.col(name).alias("name"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(W.partitionBy("name").orderBy("v"))).withColumn("n", F.sum("c").over(W.partitionBy("name")))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(p)), F.col("v")))
    return upto.groupBy("name").agg(F.sum("c").alias("n"), F.min("v").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("avg"))


def prometheus(counts: DataFrame, prefix: str = "veilspan_") -> DataFrame:
    """(line): counters (key, n) in the text form of Prometheus; label values in quotes."""
    name, labels = F.substring_index("key", "{", 1), F.regexp_extract("key", r"\{(.*)\}", 1)
    quoted = F.regexp_replace(labels, r"([^,=]+)=([^,]*)", '$1="$2"')
    body = F.when(labels == "", F.lit("")).otherwise(F.concat(F.lit("{"), quoted, F.lit("}")))
    return counts.select(F.concat(F.lit(prefix), F.regexp_replace(name, r"[^A-Za-z0-9_:]", "_"), body, F.lit(" "), F.col("n").cast("string")).alias("line"))


def sweep(found: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """(threshold, by..., n): findings with at least each confidence; each finding is counted once, then sums run over bands."""
    bands = F.size(F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: t <= F.col("confidence")))
    counted = found.groupBy(*by, bands.alias("band")).agg(F.count("*").alias("c"))
    rows = counted.select(*by, "c", F.explode(F.slice(F.array(*map(F.lit, sorted(thresholds))), F.lit(1), F.col("band"))).alias("threshold"))
    return rows.groupBy("threshold", *by).agg(F.sum("c").alias("n"))


def counters(metrics: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """(key, n): counts by name{label=value,...} with labels in order."""
    parts = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(labels)])
    return metrics.groupBy(F.concat(F.col(name), F.lit("{"), parts, F.lit("}")).alias("key")).agg(F.count("*").alias("n"))


def recall(cases: DataFrame, by: list[str]) -> DataFrame:
    """Value recall, benign specificity and F2 from rows (before, after, benign, failed)."""
    out = cases.groupBy(*by).agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.count_if("benign").alias("benign"), F.count_if(F.col("benign") & F.col("failed")).alias("benign_failed"))
    r = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before"))
    s = F.when(F.col("benign") > 0, 1 - F.col("benign_failed") / F.col("benign"))
    out = out.withColumn("recall", r).withColumn("specificity", s)
    f2 = F.when(4 * F.col("specificity") + F.col("recall") > 0, 5 * F.col("specificity") * F.col("recall") / (4 * F.col("specificity") + F.col("recall")))
    return out.select(*by, "before", "after", F.round("recall", 6).alias("recall"), F.round("specificity", 6).alias("specificity"), F.round(f2, 6).alias("f2"))


def foundation(results: DataFrame) -> DataFrame:
    """(detector, entity, tp, fn, fp, tn, recall, specificity) from rows (detector, entity, role, hit)."""
    pos, hit = F.col("role") == "positive", F.col("hit")
    out = results.groupBy("detector", "entity").agg(F.count_if(pos & hit).alias("tp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 6))
    return out.withColumn("recall", share("tp", "fn")).withColumn("specificity", share("tn", "fp"))


def below_floor(results: DataFrame, floors: DataFrame) -> DataFrame:
    """Floors (detector, entity, recall_floor, specificity_floor) that are not met; a missing result fails."""
    joined = floors.join(results, ["detector", "entity"], "left")
    bad = F.coalesce((F.col("recall") < F.col("recall_floor")) | (F.col("specificity") < F.col("specificity_floor")), F.lit(True))
    return joined.where(bad).select("detector", "entity", F.when(F.col("recall").isNull() & F.col("specificity").isNull(), "missing").otherwise("below floor").alias("reason"))


def coverage_gaps(scoped: DataFrame, emitters: DataFrame) -> DataFrame:
    """(profile, entities): scoped entities (profile, entity) that no emitter (entity) covers."""
    return scoped.join(emitters, "entity", "left_anti").groupBy("profile").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def gate(results: DataFrame, promises: DataFrame) -> DataFrame:
    """(profile, passed): every promised corpus (profile, corpus, floor) has a recall at or over its floor."""
    return promises.join(results, ["profile", "corpus"], "left").groupBy("profile").agg(F.bool_and(F.coalesce(F.col("recall") >= F.col("floor"), F.lit(False))).alias("passed"))


def vault_new(found: DataFrame, vault: DataFrame) -> DataFrame:
    """Rows (token, entity, digest) that the vault does not hold yet, one for each token."""
    return found.dropDuplicates(["token"]).join(vault, "token", "left_anti")


def vault_resolve(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    return tokens.join(vault, "token")


def merged_spans(spans: DataFrame, key: list[str], gap: int = 1) -> DataFrame:
    """Spans (key, entity, start, end, score) of one entity that touch within `gap`, merged; the best score stays."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key, "entity").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum(F.when(F.col("start") <= before + gap, 0).otherwise(1)).over(w))
    return runs.groupBy(*key, "entity", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("run")


def roles(conversations: DataFrame) -> DataFrame:
    """(surface, n, n_chars) of typed chat turns."""
    where: Column = F.when(F.col("role") == "system", "input.system").when(F.col("role") == "developer", "input.developer").when(F.col("role") == "tool", "input.tool_results").otherwise("input.messages")
    return conversations.groupBy(where.alias("surface")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))
