"""Auditable exclusion: every removed row is attributed to the first rule it breaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentgrid.functions import constants as K
from rentgrid.functions.scalars import in_bbox
from rentgrid.operators.skew import attach_per_key, first_rows, key_hash
from rentgrid.session import shared_table

BASE, PRICE = "base", "preco"
QUARANTINE = "snapshot string, id long, regra string, motivo string, escopo string"


@dataclass(frozen=True)
class Rule:
    """``broken`` is any boolean Column; NULL counts as not broken."""

    code: str
    name: str
    scope: str
    reason: str
    broken: Column
    snapshots: tuple[str, ...] = ()

    def applies(self, snapshot: str | None) -> bool:
        return not self.snapshots or snapshot is None or snapshot in self.snapshots


def mark_repeats(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Flag every row of a key but the one with the smallest ``order`` (NULL keys are equal)."""
    return mark_all_repeats(df, {flag: keys}, order)


def mark_all_repeats(df: DataFrame, flags: Mapping[str, Sequence[str]], order: str) -> DataFrame:
    """``mark_repeats`` for several flags: every key is looked up in ``df`` itself, not in the joins of the flags before.

    Only keys with more than one row are joined; they are written once, as the join reads them twice.
    """
    hashed = df.withColumns({f"_key{i}": F.unhex(key_hash(keys)) for i, keys in enumerate(flags.values())})
    out = hashed
    for i, flag in enumerate(flags):
        key = f"_key{i}"
        repeated = shared_table(first_rows(hashed, [key], order).where("_copies > 1"), "repeats")
        out = attach_per_key(out, repeated, [key], "_copies").withColumn(
            flag, F.col(order) != F.coalesce("_first", order)).drop(key, "_first", "_copies")
    return out.select(*df.columns, *flags)


def mark_groups(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Flag every member of a key with more than one row."""
    hashed = df.withColumn("_key", key_hash(keys))
    sizes = hashed.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies"))
    joined = attach_per_key(hashed, sizes, ["_key"], "_copies")
    return joined.withColumn(flag, F.col("_copies") > 1).drop("_key", "_copies")


def mark_unknown(df: DataFrame, column: str, valid: DataFrame, valid_column: str, flag: str) -> DataFrame:
    """Flag rows whose value is not in the reference list (NULL is not in it)."""
    known = (valid.select(F.col(valid_column).alias(column)).where(F.col(column).isNotNull())
             .distinct().withColumn("_known", F.lit(True)))
    return (df.join(known, column, "left")
            .withColumn(flag, F.col("_known").isNull()).drop("_known").select(*df.columns, flag))


def listing_rules(price: str = "price", lat: str = "latitude", lon: str = "longitude",
                  district: str = "district", room_type: str = "room_type",
                  min_nights: str = "minimum_nights", quote_nights: str | None = None,
                  second_snapshot: str = "2026") -> list[Rule]:
    """The rules of the listing domain; B01, B02 and B05 read flags of the ``mark_*`` operators."""
    c = F.col
    rules = [
        Rule("B01", "id_duplicado", BASE, "id repetido", c("rep_id")),
        Rule("B02", "duplicata_perfeita", BASE, "linha idêntica exceto o id", c("rep_row")),
        Rule("B03", "coordenada_fora_nyc", BASE, "coordenada nula ou fora do envelope", ~in_bbox(lat, lon)),
        Rule("B04", "distrito_invalido", BASE, "distrito fora da lista",
             ~F.coalesce(c(district).isin(*K.DISTRICTS), F.lit(False))),
        Rule("B05", "bairro_desconhecido", BASE, "bairro fora da lista", c("unknown_area")),
        Rule("B06", "room_type_invalido", BASE, "tipo fora da lista",
             ~F.coalesce(c(room_type).isin(*K.ROOM_TYPES), F.lit(False))),
        Rule("B07", "minimo_noites_invalido", BASE, "mínimo de noites nulo ou < 1",
             ~F.coalesce(c(min_nights) >= 1, F.lit(False))),
        Rule("P01", "preco_ausente", PRICE, "preço nulo", c(price).isNull()),
        Rule("P02", "preco_zero", PRICE, "preço zero", c(price) == 0),
    ]
    if quote_nights:
        rules.append(Rule("P03", "cotacao_acima_31_noites", PRICE, "cotação longa",
                          c(quote_nights) > K.QUOTE_MAX_NIGHTS, (second_snapshot,)))
    return rules + [
        Rule("P04", "preco_abaixo_piso", PRICE, "preço abaixo do piso",
             (c(price) > 0) & (c(price) < K.PRICE_FLOOR)),
        Rule("P05", "preco_acima_teto", PRICE, "preço acima do teto", c(price) > K.PRICE_CEILING),
    ]


def tag(df: DataFrame, rules: Sequence[Rule], snapshot: str | Column) -> DataFrame:
    """Add ``hits`` (one boolean per rule), ``base_hit`` and ``price_hit`` (1-based, 0 = none).

    ``snapshot`` is a label, or a column when the snapshots are stacked; a rule
    then only applies to the rows of its own snapshots.
    """
    label = F.lit(snapshot) if isinstance(snapshot, str) else snapshot

    def hit(rule: Rule) -> Column:
        broken = F.coalesce(rule.broken, F.lit(False))
        return broken & label.isin(*rule.snapshots) if rule.snapshots else broken

    def first(scope: str) -> Column:
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(rules, 1))):
            if rule.scope == scope:
                out = F.when(F.col("hits")[i - 1], F.lit(i)).otherwise(out)
        return out

    # a slice, as the planner would put the rule behind every place of a plain array that is read (each first() reads all)
    hits = F.slice(F.array(*[hit(r) for r in rules]), 1, len(rules))
    tagged = df.withColumn("hits", hits).withColumn("_snapshot", label)
    tagged = tagged.withColumn("base_hit", first(BASE))
    return tagged.withColumn("price_hit", F.when(F.col("base_hit") == 0, first(PRICE)).otherwise(F.lit(0)))


def kept(tagged: DataFrame) -> DataFrame:
    """Rows that stay in the base, with ``preco_valido``."""
    return (tagged.where("base_hit = 0").withColumn("preco_valido", F.col("price_hit") == 0)
            .drop("hits", "base_hit", "price_hit", "_snapshot"))


def quarantined(tagged: DataFrame, rules: Sequence[Rule], id_column: str = "id") -> DataFrame:
    """Excluded rows with their rule, reason and scope."""
    first = F.greatest("base_hit", "price_hit")

    def text(pick) -> Column:
        return F.element_at(F.array(*[F.lit(pick(r)) for r in rules]), first)

    return tagged.where(first > 0).select(
        F.col("_snapshot").alias("snapshot"), F.col(id_column).cast("long").alias("id"),
        text(lambda r: r.code).alias("regra"), text(lambda r: r.reason).alias("motivo"),
        text(lambda r: r.scope).alias("escopo"))


def rule_report(tagged: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per snapshot and rule: rows that match it, and rows attributed to it."""
    attributed = F.greatest("base_hit", "price_hit")
    counts = tagged.groupBy("_snapshot").agg(
        F.count(F.lit(1)).alias("entrada"),
        *[F.count_if(F.col("hits")[i]).alias(f"m{i}") for i in range(len(rules))],
        *[F.count_if(attributed == i + 1).alias(f"a{i}") for i in range(len(rules))])
    rows = F.array(*[F.struct(
        F.lit(i).alias("ordem"), F.lit(r.code).alias("codigo"), F.lit(r.name).alias("regra"),
        F.lit(r.scope).alias("escopo"), F.array(*[F.lit(s) for s in r.snapshots]).cast("array<string>").alias("_only"),
        F.col(f"m{i}").alias("casam"), F.col(f"a{i}").alias("cascata")) for i, r in enumerate(rules)])
    return (counts.select(F.col("_snapshot").alias("snapshot"), "entrada", F.explode(rows).alias("r"))
            .select("snapshot", "entrada", "r.*")
            .where((F.size("_only") == 0) | F.array_contains("_only", F.col("snapshot"))).drop("_only"))


def cascade_report(report: DataFrame) -> DataFrame:
    """Rule report with the rows remaining after each rule (rules x snapshots rows, a tiny window)."""
    by_scope = Window.partitionBy("snapshot").orderBy("ordem").rowsBetween(Window.unboundedPreceding, 0)
    return report.withColumn("restam", F.col("entrada") - F.sum("cascata").over(by_scope))


def tags(tagged: DataFrame) -> DataFrame:
    """What reports read of tagged rows, written once: a report, its check and its result are passes of their own."""
    return shared_table(tagged.select("_snapshot", "hits", "base_hit", "price_hit"), "tags")


def check_balance(report: DataFrame, tagged: DataFrame) -> DataFrame:
    """``report`` itself, or an error when input - removed != kept or kept - price != valid."""
    sums = {r["snapshot"]: r for r in report.groupBy("snapshot").agg(
        F.max("entrada").alias("n"),
        F.sum(F.when(F.col("escopo") == BASE, F.col("cascata")).otherwise(0)).alias("base"),
        F.sum(F.when(F.col("escopo") == PRICE, F.col("cascata")).otherwise(0)).alias("price")).collect()}
    real = tagged.groupBy("_snapshot").agg(
        F.count_if(F.col("base_hit") == 0).alias("kept"),
        F.count_if((F.col("base_hit") == 0) & (F.col("price_hit") == 0)).alias("valid")).collect()
    for r in real:
        s = sums[r["_snapshot"]]
        if s["n"] - s["base"] != r["kept"] or r["kept"] - s["price"] != r["valid"]:
            raise ValueError(f"cascade of {r['_snapshot']} does not add up")
    return report


def rule_matrix(report: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """Rule x snapshot; NULL where a rule does not apply to a snapshot."""
    return report.groupBy("codigo").agg(*[
        F.max(F.when(F.col("snapshot") == s, F.col(c))).alias(f"{c}_{s}")
        for s in snapshots for c in ("casam", "cascata")])


def scope_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("snapshot", "escopo").agg(F.count(F.lit(1)).alias("n"))


def empty_quarantine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUARANTINE)


def neutral_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename snapshot-specific columns to the names the rules use."""
    return df.withColumnsRenamed(dict(names))
