"""Occupation codes matched at a shared depth.

A shared key is ``isco08:`` and one, two or four digits, or the sentinel ``unmapped``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = "isco08"
UNMAPPED = "unmapped"
# The depths of the classification, deepest first, and the confidence words of each.
DEPTHS = (4, 2, 1)
CONFIDENCE_BY_DEPTH = {4: ("high", "moderate"), 2: ("2-digit-only",), 1: ("major-group-only",)}
UNMAPPED_CONFIDENCE = "no-isco-correspondence"


def code_of(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, rf"^{SCHEME}:(\d{{4}}|\d{{2}}|\d)$", 1), F.lit(""))


def depth_of(key: Column) -> Column:
    return F.length(code_of(key))


def compare(key_a: Column, key_b: Column, who_a: Column, who_b: Column) -> Column:
    """struct(comparable, depth, shared_key, degraded_by, reason): both codes cut to the shallower depth."""
    code_a, code_b = code_of(key_a), code_of(key_b)
    da, db = F.length(code_a), F.length(code_b)
    depth = F.least(da, db)
    cut_a, cut_b = F.substring(code_a, F.lit(1), depth), F.substring(code_b, F.lit(1), depth)
    blamed = F.when(da.isNull(), who_a).otherwise(who_b)
    missing = da.isNull() | db.isNull()
    same = F.coalesce(cut_a == cut_b, F.lit(False))
    return F.struct(
        same.alias("comparable"),
        F.when(same, depth).alias("depth"),
        F.when(same, F.concat(F.lit(f"{SCHEME}:"), cut_a)).alias("shared_key"),
        F.when(
            same & (da != db),
            F.concat(
                F.when(da < db, who_a).otherwise(who_b),
                F.lit(" forces "), F.greatest(da, db).cast("string"), F.lit(" digits down to "), depth.cast("string"),
            ),
        ).alias("degraded_by"),
        F.when(missing, F.concat(blamed, F.lit(" has no correspondence")))
        .when(~same, F.concat(F.lit("codes differ at "), depth.cast("string"), F.lit(" digits")))
        .alias("reason"),
    )


def comparable_pair_counts(df: DataFrame, key: str) -> DataFrame:
    """How many unordered pairs of rows are comparable, by the depths of the two sides.

    Rows are first reduced to counts per distinct key (the classification bounds them), each
    key is laid out at every depth it reaches, and pairs are counted by multiplication, so
    no pair is ever built.
    """
    code = code_of(F.col(key))
    counts = df.select(code.alias("code")).filter(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    reach = F.filter(F.array(*[F.lit(d) for d in DEPTHS]), lambda d: d <= F.length("code"))
    at = counts.select(F.length("code").alias("own"), "n", "code", F.explode(reach).alias("depth"))
    at = at.groupBy("depth", F.substring("code", F.lit(1), F.col("depth")).alias("prefix")).agg(
        *[F.sum(F.when(F.col("own") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in DEPTHS]
    )
    rows = []
    for shallow in DEPTHS:
        for deep in (d for d in DEPTHS if d >= shallow):
            a, b = F.col(f"n{shallow}"), F.col(f"n{deep}")
            pairs = (a * (a - 1) / 2) if shallow == deep else a * b
            rows.append(
                F.struct(
                    F.lit(shallow).alias("depth"), F.lit(deep).alias("deeper_side"),
                    F.when(F.col("depth") == shallow, pairs).otherwise(0).cast("long").alias("pairs"),
                )
            )
    out = at.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.groupBy("depth", "deeper_side").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")


def resolve_set(df: DataFrame, group: Sequence[str], label: str, base: str, depth: str, quorum: int = 2) -> DataFrame:
    """Deepest depth shared by at least ``quorum`` distinct bases of a set; only rows at exactly
    that depth stay comparable, the others say why. A null ``depth`` is a row refused earlier."""
    per_depth = (
        df.filter(F.col(depth).isNotNull())
        .groupBy(*group)
        .agg(*[F.count_distinct(F.when(F.col(depth) == d, F.col(base))).alias(f"__b{d}") for d in DEPTHS])
    )
    resolved = F.coalesce(*[F.when(F.col(f"__b{d}") >= quorum, d) for d in DEPTHS])
    per_set = per_depth.select(
        *group,
        resolved.alias("resolved_depth"),
        F.coalesce(*[F.when(F.col(f"__b{d}") >= quorum, F.col(f"__b{d}")) for d in DEPTHS]).alias("sharing"),
    )
    out = df.join(per_set, list(group), "left")
    own, res = F.col(depth), F.col("resolved_depth")
    fit = F.coalesce(own == res, F.lit(False))
    return out.withColumn("comparable", fit).withColumn(
        "reason",
        F.when(own.isNull(), "no correspondence")
        .when(res.isNull(), F.concat(F.lit(f"fewer than {quorum} share depth "), own.cast("string")))
        .when(own < res, F.concat(F.lit("reaches only "), own.cast("string"), F.lit(" of "), res.cast("string"), F.lit(" digits")))
        .when(own > res, F.concat(F.lit("scoped to "), own.cast("string"), F.lit(" digits, the set shares "), res.cast("string"))),
    )


def registry_findings(mappings: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """Rules over a crosswalk: unique pair, known key, depth against confidence, evidence note, live title."""
    pair = F.concat_ws("/", "country", "national_code")
    key, conf = F.col("shared_key"), F.col("confidence")
    depth = depth_of(key)
    finding = lambda rule, field, detail: F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), detail.cast("string").alias("observed"))
    known = registry.select("shared_key").distinct().withColumn("__known", F.lit(True))
    titles = live.select("source_id", "national_code", F.col("title").alias("__title"))
    sources = live.select("source_id").distinct().withColumn("__source", F.lit(True))
    df = (
        mappings.join(known, "shared_key", "left")
        .join(titles, ["source_id", "national_code"], "left")
        .join(sources, "source_id", "left")
    )
    unmapped = key == UNMAPPED
    expected = F.coalesce(*[F.when(depth == d, conf.isin(*words)) for d, words in CONFIDENCE_BY_DEPTH.items()])
    words = [w for ws in CONFIDENCE_BY_DEPTH.values() for w in ws] + [UNMAPPED_CONFIDENCE]
    note = F.trim(F.coalesce("note", F.lit("")))
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(conf.isin(*words), F.lit(False)), finding("known_confidence", "confidence", conf)),
            F.when(F.length(note) < 40, finding("note_is_evidence", "note", F.length(note))),
            F.when(~unmapped & depth.isNull(), finding("well_formed_key", "shared_key", key)),
            F.when(unmapped & (conf != UNMAPPED_CONFIDENCE), finding("unmapped_confidence", "confidence", conf)),
            F.when(depth.isNotNull() & F.col("__known").isNull(), finding("registered_key", "shared_key", key)),
            F.when(depth.isNotNull() & ~expected, finding("depth_confidence", "confidence", conf)),
            F.when(F.col("__source").isNotNull() & F.col("__title").isNull(), finding("live_code", "national_code", F.col("national_code"))),
            F.when(F.col("__title") != F.col("national_title"), finding("live_title", "national_title", F.col("national_title"))),
        )
    )
    rows = df.select(pair.alias("entity"), F.explode(rules).alias("f")).select("entity", "f.*")
    twice = mappings.groupBy(pair.alias("entity")).count().filter("count > 1").select(
        "entity", F.lit("unique_pair").alias("rule"), F.lit("national_code").alias("field"), F.col("count").cast("string").alias("observed")
    )
    return rows.unionByName(twice)


PLACEHOLDER_NOTE = r"(?i)(?U:\b)(?:todo|tbd|fixme|placeholder|lorem|xxx)(?U:\b)"


def note_findings(mappings: DataFrame, note: str = "note") -> DataFrame:
    """Notes too short, with too few different characters, or made of placeholder words."""
    text = F.trim(F.coalesce(note, F.lit("")))
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return mappings.select(
        F.concat_ws("/", "country", "national_code").alias("entity"),
        F.when(F.length(text) < 40, "short")
        .when(distinct < 8, "few_characters")
        .when(text.rlike(PLACEHOLDER_NOTE), "placeholder")
        .alias("rule"),
    ).filter("rule is not null")
