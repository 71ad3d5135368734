"""Small literal tables, as a DataFrame and as DuckDB VALUES."""

from __future__ import annotations

from siftline.session import table


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + x.replace("'", "''") + "'"


class Fixture:
    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(",")]

    def frame(self, spark):
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in self.rows)}) AS v({', '.join(self.names)}))"


class Mixed:
    """A literal table and all rows of an input table, whose columns are expressions that both engines read."""

    def __init__(self, fixture: Fixture, source: str, columns: tuple[str, ...], where: str = "text IS NOT NULL"):
        self.fixture, self.source, self.where = fixture, source, where
        self.columns = [f"{x} AS {n}" for x, n in zip(columns, fixture.names)]

    def frame(self, spark, sf):
        rows = table(spark, sf, self.source).where(self.where).selectExpr(*self.columns)
        own = self.fixture.frame(spark)
        return own.select(*(own[c].cast(t) for c, t in rows.dtypes)).unionByName(rows)

    @property
    def sql(self) -> str:
        return f"({self.fixture.sql} UNION ALL SELECT {', '.join(self.columns)} FROM {self.source} WHERE {self.where})"
