"""Column contracts: declared once, checked in one aggregate, never repaired silently."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATIONS = "column string, violation string, n long"


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a table and what its values may be."""

    name: str
    dtype: str
    description: str = ""
    origin: str = ""
    outputs: tuple[str, ...] = ()
    personal: bool = False
    minimum: float | None = None
    maximum: float | None = None
    domain: tuple[str, ...] = ()
    nullable: bool = True

    def field(self) -> T.StructField:
        meta: dict[str, Any] = {"personal": self.personal, "nullable": self.nullable}
        if self.domain:
            meta["domain"] = list(self.domain)
        return T.StructField(self.name, T._parse_datatype_string(self.dtype), True, meta)


@dataclass(frozen=True)
class Contract:
    columns: tuple[ColumnSpec, ...]
    raw: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def for_output(self, output: str) -> Contract:
        return Contract(tuple(c for c in self.columns if not c.outputs or output in c.outputs), self.raw)

    def public(self) -> Contract:
        return Contract(tuple(c for c in self.columns if not c.personal), self.raw)


class ContractError(ValueError):
    """A table breaks its contract; nothing may be written from it."""


def project(df: DataFrame, contract: Contract) -> DataFrame:
    return df.select(*contract.names)


def _value_rules(spec: ColumnSpec, value: Column) -> dict[str, Column]:
    rules = {}
    if not spec.nullable:
        rules["null"] = value.isNull()
    if spec.domain:
        rules["domain"] = value.isNotNull() & ~value.isin(*spec.domain)
    if spec.minimum is not None:
        rules["minimum"] = value < F.lit(spec.minimum)
    if spec.maximum is not None:
        rules["maximum"] = value > F.lit(spec.maximum)
    return rules


def _count_rules(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Long table of violated rules from a single aggregate over ``df``."""
    if not rules:
        return df.sparkSession.createDataFrame([], VIOLATIONS)
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}")
                      for i, (_, _, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("violation"),
                              F.col(f"r{i}").alias("n")) for i, (a, b, _) in enumerate(rules)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def validate(df: DataFrame, contract: Contract, public: bool = False) -> DataFrame:
    """Every violation as ``(column, violation, n)``; an empty result means valid."""
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shape = [(c.name, "missing") for c in contract.columns if c.name not in schema]
    shape += [(c, "extra") for c in schema if c not in contract.names]
    shared = [c for c in df.columns if c in contract.names]
    if shared != [c for c in contract.names if c in schema]:
        shape.append(("*", "order"))
    for c in contract.columns:
        want = T._parse_datatype_string(c.dtype).simpleString()
        if c.name in schema and schema[c.name] != want:
            shape.append((c.name, f"dtype {schema[c.name]} instead of {want}"))
        if public and c.personal and c.name in schema:
            shape.append((c.name, "personal"))
    rules = [(c.name, rule, broken) for c in contract.columns if c.name in schema
             for rule, broken in _value_rules(c, F.col(c.name)).items()]
    found = _count_rules(df, rules)
    if not shape:
        return found
    rows = df.sparkSession.createDataFrame([(a, b, 1) for a, b in shape], VIOLATIONS)
    return rows.unionByName(found)


def require_valid(df: DataFrame, contract: Contract, public: bool = False) -> DataFrame:
    """``df`` itself, or ``ContractError`` with every violation."""
    found = validate(df, contract, public).collect()    # at most a few rules per column
    if found:
        raise ContractError("; ".join(f"{r['column']}: {r['violation']} ({r['n']})" for r in found))
    return df


def apply_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast to the contract types; a value that the cast or the domain would lose fails."""
    rules, casted = [], []
    for c in contract.columns:
        if c.name not in df.columns:
            raise ContractError(f"{c.name}: missing")
        value = F.col(c.name).try_cast(T._parse_datatype_string(c.dtype))
        casted.append(value.alias(c.name, metadata=c.field().metadata))
        rules.append((c.name, "cast", F.col(c.name).isNotNull() & value.isNull()))
        if c.domain:
            rules.append((c.name, "domain", value.isNotNull() & ~value.isin(*c.domain)))
        if c.dtype == "boolean" and not c.nullable:
            rules.append((c.name, "null", value.isNull()))
    broken = _count_rules(df, rules).collect()
    if broken:
        raise ContractError("; ".join(f"{r['column']}: {r['violation']} ({r['n']})" for r in broken))
    return df.select(*casted)


def assert_no_personal(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Schema check only, no job: personal columns never leave."""
    named = {c.name for c in contract.columns if c.personal} if contract else set()
    marked = {f.name for f in df.schema.fields if f.metadata.get("personal")}
    leaked = sorted((named | marked) & set(df.columns))
    if leaked:
        raise ContractError(f"personal columns in a published table: {leaked}")
    return df


def check_header(columns: Sequence[str], declared: Sequence[str]) -> list[str]:
    """Differences between a file's header and its declared raw columns."""
    out = [f"missing {c}" for c in declared if c not in columns]
    out += [f"undeclared {c}" for c in columns if c not in declared]
    return out


def null_counts(df: DataFrame, name: str = "n") -> DataFrame:
    """``(column, n)`` for every column, from one aggregate."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def null_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return null_counts(before, "n_before").join(null_counts(after, "n_after"), "column", "full_outer")


def dictionary(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract as a table beside what the data shows (nulls, smallest, largest value)."""
    spark = df.sparkSession
    declared = spark.createDataFrame(
        [(i, c.name, c.dtype, list(c.outputs), list(c.domain), c.personal, c.description, c.origin)
         for i, c in enumerate(contract.columns)],
        "position int, column string, dtype string, outputs array<string>, domain array<string>, "
        "personal boolean, description string, origin string")
    names = [c for c in contract.names if c in df.columns]
    seen = df.agg(*reduce(lambda acc, c: acc + [
        F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.min(c).cast("string").alias(f"lo_{c}"),
        F.max(c).cast("string").alias(f"hi_{c}")], names, []))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"),
                              F.col(f"lo_{c}").alias("lowest"), F.col(f"hi_{c}").alias("highest"))
                     for c in names])
    observed = seen.select(F.explode(rows).alias("r")).select("r.*")
    # a personal value must not leak through its extremes
    hidden = [c.name for c in contract.columns if c.personal]
    if hidden:
        keep = ~F.col("column").isin(*hidden)
        observed = observed.select("column", "nulls", *[F.when(keep, F.col(c)).alias(c)
                                                        for c in ("lowest", "highest")])
    return declared.join(observed, "column", "left")


def raw_dictionary(spark, treatments: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Per raw column: source file, name, treatment (kept, renamed, derived, dropped) and reason."""
    return spark.createDataFrame(list(treatments),
                                 "source string, column string, treatment string, reason string")
