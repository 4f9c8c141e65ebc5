"""Keys, references, headers and join cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_column(df: DataFrame, names: list[str], required: bool = True) -> str | None:
    """First wanted column that exists: same letters, then without spaces and ``_``."""

    def packed(name: str) -> str:
        return name.lower().replace(" ", "").replace("_", "")

    for form in (lambda n: n.lower().strip(), packed):
        have = {form(c): c for c in df.columns}
        for name in names:
            if form(name) in have:
                return have[form(name)]
    if required:
        raise ValueError(f"none of the columns {names} in {df.columns}")
    return None


def validate_headers(tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> list[str]:
    """Messages for all tables whose columns are not the expected list."""
    problems = []
    for name, df in tables.items():
        want = expected.get(name)
        if want is not None and df.columns != want:
            missing = [c for c in want if c not in df.columns]
            extra = [c for c in df.columns if c not in want]
            problems.append(f"{name}: missing {missing}, extra {extra}" + ("" if missing or extra else ", other order"))
    return problems


def _filled(name: str, df: DataFrame) -> DataFrame:
    """One row per column: its place and how many rows have a value, from one pass over the table."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("found_at"), F.col(f"c{i}").alias("n_filled")) for i, c in enumerate(df.columns)]
    return counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*each)))


def header_report(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> DataFrame:
    """Headers against expected ones as rows: table_name, column_name, expected_at, found_at, problem, n_filled.

    ``problem`` is ``ok``, ``other place``, ``missing``, ``extra``, ``empty`` (no row has a value) or ``missing table``.
    Tables without an expectation are left out.
    """
    wanted = [(t, c, i + 1) for t, columns in expected.items() for i, c in enumerate(columns)]
    wanted = spark.createDataFrame(wanted, "table_name string, column_name string, expected_at int")
    known = [(t,) for t in expected if t in tables]
    found = spark.createDataFrame([], "table_name string, column_name string, found_at int, n_filled bigint")
    for (name,) in known:
        found = found.unionByName(_filled(name, tables[name]))
    present = F.col("table_name").isin([t for (t,) in known]) if known else F.lit(False)
    problem = (
        F.when(~present, "missing table")
        .when(F.col("found_at").isNull(), "missing")
        .when(F.col("expected_at").isNull(), "extra")
        .when(F.col("found_at") != F.col("expected_at"), "other place")
        .when(F.col("n_filled") == 0, "empty")
        .otherwise("ok")
    )
    joined = wanted.join(found, ["table_name", "column_name"], "full")
    return joined.select("table_name", "column_name", "expected_at", "found_at", problem.alias("problem"), "n_filled")


def missing_parts(spark: SparkSession, tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Required tables and columns that are absent or hold nothing, with a message each."""
    report = header_report(spark, tables, required).where(F.col("problem").isin("missing", "missing table", "empty"))
    text = F.when(F.col("problem") == "missing table", F.concat(F.lit("no table "), "table_name")).otherwise(
        F.concat("table_name", F.lit(": column "), "column_name", F.lit(" is "), "problem")
    )
    return report.select("table_name", F.when(F.col("problem") != "missing table", F.col("column_name")).alias("column_name"), "problem", text.alias("message")).distinct()


def column_report(spark: SparkSession, tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """What ``pick_column`` finds in each table for each wanted name, with the values there: table_name, wanted, chosen, n_filled."""
    chosen = [(t, w, pick_column(df, names, required=False)) for t, df in tables.items() for w, names in wanted.items()]
    rows = spark.createDataFrame(chosen, "table_name string, wanted string, column_name string")
    found = spark.createDataFrame([], "table_name string, column_name string, found_at int, n_filled bigint")
    for name in {t for t, _, c in chosen if c is not None}:
        found = found.unionByName(_filled(name, tables[name].select(*{f"`{c}`" for t, _, c in chosen if t == name and c is not None})))
    return rows.join(found.drop("found_at"), ["table_name", "column_name"], "left").withColumnRenamed("column_name", "chosen")


def require(present: list[str], wanted: list[str], what: str = "table") -> None:
    """Stop with the names of all that is missing."""
    missing = [w for w in wanted if w not in present]
    if missing:
        raise ValueError(f"missing {what}: {', '.join(missing)}")


def check_fk(
    child: DataFrame, column: str, parent: DataFrame, key: str, name: str, nullable: bool = False, shown: int = 10
) -> DataFrame:
    """One row: child rows whose reference is not in the parent, with examples.

    The examples are the smallest distinct missing values, at most ``shown``.
    """
    refs = child.select(F.col(column).alias("_ref"))
    present = parent.select(F.col(key).alias("_ref"))
    lost = refs.join(present, "_ref", "left_anti")
    if nullable:
        lost = lost.where(F.col("_ref").isNotNull())
    per_value = lost.groupBy("_ref").agg(F.count(F.lit(1)).alias("_n"))
    examples = per_value.where(F.col("_ref").isNotNull()).select("_ref").orderBy("_ref").limit(shown)
    listed = examples.agg(F.array_join(F.array_sort(F.collect_list("_ref")), ", ").alias("e"))
    return per_value.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_missing")).select(
        F.lit(name).alias("relation"), "n_missing", listed.scalar().alias("examples")
    )


def check_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has."""
    left = a.select(key).join(b.select(key), key, "left_anti").select(key, F.lit("missing_in_second").alias("problem"))
    right = b.select(key).join(a.select(key), key, "left_anti").select(key, F.lit("missing_in_first").alias("problem"))
    return left.unionByName(right)


def check_pk(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


# References checked after a load, as (child, column, parent, key, nullable).
RELATIONS = [
    ("genomes", "species_pk", "natural_history", "species_pk", True),
    ("sequences", "genome_pk", "genomes", "genome_pk", False),
    ("window_set", "genome_pk", "genomes", "genome_pk", False),
    ("genomic_windows", "window_set_pk", "window_set", "window_set_pk", False),
    ("genomic_windows", "sequence_pk", "sequences", "sequence_pk", False),
    ("gc_window_stats", "window_pk", "genomic_windows", "window_pk", False),
    ("sequence_summary", "sequence_pk", "sequences", "sequence_pk", False),
    ("sequence_summary", "genome_pk", "genomes", "genome_pk", False),
    ("genome_summary", "genome_pk", "genomes", "genome_pk", False),
    ("genome_summary", "species_pk", "natural_history", "species_pk", True),
]


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphan rows per reference, for the tables at hand."""
    rows = None
    for child, column, parent, key, nullable in RELATIONS:
        if child not in tables or parent not in tables:
            continue
        lost = tables[child].select(F.col(column).alias("_ref")).join(
            tables[parent].select(F.col(key).alias("_ref")), "_ref", "left_anti"
        )
        if nullable:
            lost = lost.where(F.col("_ref").isNotNull())
        one = lost.agg(F.count(F.lit(1)).alias("n_orphans")).select(
            F.lit(f"{child}.{column}").alias("relation"), "n_orphans"
        )
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no reference has both of its tables")
    return rows


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str, validate: str) -> DataFrame:
    """Join after checking that the sides are unique where ``m:1`` or ``1:1`` says so."""
    if validate not in ("m:1", "1:1"):
        raise ValueError(f"unknown cardinality {validate!r}")
    sides = {"right": right, **({"left": left} if validate == "1:1" else {})}
    for side, df in sides.items():
        doubled = check_pk(df.dropna(subset=on), on).limit(5).collect()
        if doubled:
            keys = ", ".join("/".join(str(r[c]) for c in on) for r in doubled)
            raise ValueError(f"{side} side of the {validate} join repeats {keys}")
    return left.join(right, on, how)
