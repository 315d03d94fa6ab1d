"""Advice rules and domain checks, both as one array expression per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import is_numeric, number_or_null, quoted


@dataclass(frozen=True)
class Rule:
    """`text` applies where column op value holds; op is =, > or <."""

    column: str
    op: str
    value: float
    text: str

    def holds(self, have: set[str]) -> Column:
        # an absent field counts as 0; NaN satisfies nothing
        x = F.coalesce(quoted(self.column).cast("double"), F.lit(0.0)) if self.column in have else F.lit(0.0)
        v = F.lit(float(self.value))
        if self.op == "=":
            return (x == v) & ~F.isnan(x)
        if self.op == ">":
            return (x > v) & ~F.isnan(x)
        if self.op == "<":
            return (x < v) & ~F.isnan(x)
        raise ValueError(f"unknown operator {self.op!r}")


def apply_rules(df: DataFrame, rules: list[Rule], fallback: str, out: str = "recommendations") -> DataFrame:
    """Add the texts of all rules that hold, in rule order, or the fallback alone."""
    have = set(df.columns)
    hits = F.array_compact(F.array(*[F.when(r.holds(have), F.lit(r.text)) for r in rules]))
    told = df.withColumn(out, hits)
    return told.withColumn(out, F.when(F.size(out) == 0, F.array(F.lit(fallback))).otherwise(F.col(out)))


@dataclass(frozen=True)
class Constraint:
    """A required field with a code list or a closed range."""

    column: str
    codes: tuple = ()
    low: float | None = None
    high: float | None = None
    required: bool = True

    def broken(self, df: DataFrame) -> list[Column]:
        """One nullable text per kind of violation."""
        if self.column not in df.columns:
            return [F.lit(f"{self.column}: missing")] if self.required else []
        c = quoted(self.column)
        numeric = is_numeric(df.schema[self.column].dataType)
        absent = c.isNull() if numeric else c.isNull() | (F.trim(c) == "")
        x = c.cast("double") if numeric else number_or_null(c)
        out = []
        if self.required:
            out.append(F.when(absent, F.lit(f"{self.column}: missing")))
        if self.codes:
            ok = F.coalesce(x.isin(*[float(v) for v in self.codes]), F.lit(False))
            out.append(F.when(~absent & ~ok, F.lit(f"{self.column}: code")))
        if self.low is not None or self.high is not None:
            ok = x.isNotNull() & ~F.isnan(x)
            if self.low is not None:
                ok = ok & (x >= F.lit(float(self.low)))
            if self.high is not None:
                ok = ok & (x <= F.lit(float(self.high)))
            out.append(F.when(~absent & ~F.coalesce(ok, F.lit(False)), F.lit(f"{self.column}: range")))
        return out


def validate(df: DataFrame, constraints: list[Constraint], out: str = "violations") -> DataFrame:
    """Add the array of violated constraints, empty for a clean row."""
    checks = [c for k in constraints for c in k.broken(df)]
    none = F.array().cast("array<string>")
    return df.withColumn(out, F.array_compact(F.array(*checks)) if checks else none)


def violation_counts(validated: DataFrame, col: str = "violations") -> DataFrame:
    """(violation, n) over all rows.

    explode would add a filter on the array's size and so run all checks twice
    per row; explode_outer does not.
    """
    each = validated.select(F.explode_outer(col).alias("violation")).where(F.col("violation").isNotNull())
    return each.groupBy("violation").agg(F.count("*").alias("n"))
