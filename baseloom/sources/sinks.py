"""Writers: delimited tables, chunks, FASTA, PHYLIP, JSON, logs, table loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.functions.cleaning import canonical_bool, file_token, null_if_blank, to_number
from baseloom.operators.ranking import assign_pk
from baseloom.operators.validate import check_pk

# Columns that are booleans in the tables.
BOOLEAN_COLUMNS = ["passes_raw_cds_qc", "terminal_stop", "keep_flag", "is_current"]


def _formatted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in order as text; keys as integers, missing columns NULL."""

    def cell(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("string").alias(name)
        text = null_if_blank(F.col(name))
        if name.endswith("_pk"):
            text = F.coalesce(to_number(text).cast("bigint").cast("string"), text)
        return text.alias(name)

    return df.select(*[cell(c) for c in columns])


def write_tsv(df: DataFrame, path: str, columns: list[str], null: str = "\\N", header: bool = True) -> None:
    """Tab-separated files with fixed columns; extra columns are left out."""
    writer = _formatted(df, columns).write.option("sep", "\t").option("header", header).option("nullValue", null)
    writer.option("emptyValue", "").option("escape", '"').csv(path)


def write_chunks(df: DataFrame, root: str, table: str, columns: list[str]) -> DataFrame:
    """Compressed files per run, genome, window size and step; returns the manifest.

    A genome's share may be written by several tasks, so a large genome gives
    several files and no task writes it alone.
    """
    keys = ["run_pk", "genome_pk", "standard_window_size_bp", "step_size_bp"]
    path = f"{root}/{table}"
    parts = df.withColumns({f"by_{k}": F.col(k) for k in keys}).withColumn(
        "by_accession", file_token(F.col("accession_id"))
    )
    folders = [*[f"by_{k}" for k in keys], "by_accession"]
    # Rebalancing gathers a folder's rows in few files and splits large folders.
    writer = _formatted(parts, [*columns, *folders]).hint("rebalance", *folders).write.partitionBy(*folders)
    writer.option("sep", "\t").option("header", True).option("nullValue", "\\N").option("compression", "gzip").csv(path)
    written = df.sparkSession.read.option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(path)
    return written.groupBy(
        F.lit(table).alias("table_name"),
        F.col("_metadata.file_path").alias("chunk_path"),
        *[F.col(f"by_{k}").cast("bigint").alias(k) for k in keys],
        F.col("by_accession").alias("accession_id"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def clean_for_load(df: DataFrame) -> DataFrame:
    """NULL words to NULL and boolean words to booleans; an unknown one is an error."""

    def cell(name: str, kind: str) -> Column:
        if kind != "string":
            return F.col(name)
        return (canonical_bool(F.col(name), "strict") if name in BOOLEAN_COLUMNS else null_if_blank(F.col(name), "feature")).alias(name)

    return df.select(*[cell(n, t) for n, t in df.dtypes])


def column_report(new: DataFrame, target: DataFrame) -> dict[str, list[str]]:
    """Columns a load uses, those it ignores and those it leaves empty."""
    shared = [c for c in target.columns if c in new.columns]
    if not shared:
        raise ValueError("source and target share no column")
    return {
        "loaded": shared,
        "ignored": [c for c in new.columns if c not in target.columns],
        "missing": [c for c in target.columns if c not in new.columns],
    }


def load_table(target: DataFrame, new: DataFrame, keys: list[str], mode: str, order: str | None = None) -> DataFrame:
    """The table after a load.

    ``insert`` appends and fails on a repeated key, ``ignore`` keeps existing
    rows (and the first of repeated new ones), ``replace`` lets new ones (the
    last of repeated ones) win. ``order`` is the row order of ``new``.
    """
    shared = column_report(new, target)["loaded"]
    types = dict(target.dtypes)
    rows = clean_for_load(new.select(*shared, *([order] if order and order not in shared else [])))
    rows = rows.select(
        *[F.col(c).cast(types[c]).alias(c) if c in shared else F.lit(None).cast(types[c]).alias(c) for c in target.columns],
        *([F.col(order).alias("_o")] if order else [F.lit(0).alias("_o")]),
    )
    if mode == "insert":
        plain = rows.drop("_o")
        doubled = check_pk(target.select(*keys).unionByName(plain.select(*keys)), keys).limit(5).collect()
        if doubled:
            raise ValueError("repeated keys: " + ", ".join(str(tuple(r[k] for k in keys)) for r in doubled))
        return target.unionByName(plain)
    pick = {"ignore": F.min, "replace": F.max}.get(mode)
    if pick is None:
        raise ValueError(f"unknown mode {mode!r}")
    rest = [c for c in target.columns if c not in keys]
    one = rows.groupBy(*keys).agg(pick(F.struct("_o", *rest)).alias("_b")).select(*keys, *[F.col(f"_b.{c}") for c in rest])
    one = one.select(*target.columns)
    if mode == "ignore":
        return target.unionByName(one.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    return target.join(one.select(*keys), keys, "left_anti").select(*target.columns).unionByName(one)


def load_report(target: DataFrame, new: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """What a load would do, without doing it: new and clashing rows."""
    clash = new.join(target.select(*keys), keys, "left_semi").agg(F.count(F.lit(1))).scalar()
    return new.agg(F.count(F.lit(1)).alias("n_source_rows")).select(
        F.lit(mode).alias("mode"), "n_source_rows", clash.alias("n_key_clashes")
    )


def write_fasta(df: DataFrame, path: str, group: str, name: str, seq: str = "seq") -> None:
    """FASTA text in one folder per group (gene)."""
    record = F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq))
    rows = df.select(F.col(group).alias("group"), record.alias("value")).hint("rebalance", "group")
    rows.write.partitionBy("group").text(path)


def write_nested_json(df: DataFrame, path: str, child: str, parent: str, value: str) -> None:
    """One JSON object ``{child: {parent: value}}`` per child and line."""
    nested(df, child, parent, value).select("value").write.text(path)


def nested(df: DataFrame, child: str, parent: str, value: str) -> DataFrame:
    """Nested JSON per child; a tree node has one parent, so each object is small."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(parent), F.col(value)))))
    return df.groupBy(child).agg(pairs.alias("_m")).select(
        child, F.to_json(F.create_map(F.col(child), F.col("_m")), {"ignoreNullFields": "false"}).alias("value")
    )


def phylip_lines(aln: DataFrame) -> DataFrame:
    """Relaxed PHYLIP lines: a header line per alignment, then its sequences."""
    head = aln.groupBy("alignment").agg(
        F.concat_ws(" ", F.lit(""), F.count(F.lit(1)), F.max(F.length("seq"))).alias("value")
    )
    body = aln.select("alignment", F.col("sequence_id").alias("_name"), F.concat_ws(" ", "sequence_id", "seq").alias("value"))
    return head.select("alignment", F.lit("").alias("_name"), "value").unionByName(body)


def write_phylip(aln: DataFrame, path: str) -> None:
    """PHYLIP text in one folder per alignment; part files are in line order."""
    lines = phylip_lines(aln).repartitionByRange("alignment", "_name").sortWithinPartitions("alignment", "_name")
    lines.select("alignment", "value").write.partitionBy("alignment").text(path)


def append_log(df: DataFrame, path: str, form: str = "json") -> None:
    """Append events to a log folder; earlier files stay as they are."""
    writer = df.write.mode("append")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def edges_wide(edges: DataFrame, width: int = 1_000) -> DataFrame:
    """The wide table's two lines, ``line`` 0 the children in order and 1 their parents, as CSV text pieces.

    A child with several parents keeps the smallest. A piece holds ``width`` nodes, so the number of
    pieces grows with the tree; pieces of one number belong together.
    """
    numbered = assign_pk(edges.groupBy("child").agg(F.min("parent").alias("parent")), ["child"], "_at", 0)

    def cells(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        cell = F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)
        ordered = F.array_sort(F.collect_list(F.struct("_at", cell.alias("c"))))
        return F.array_join(ordered["c"], ",")

    pieces = numbered.groupBy(F.floor(F.col("_at") / width).alias("piece")).agg(cells("child").alias("_0"), cells("parent").alias("_1"))
    lines = F.array(*[F.struct(F.lit(i).alias("line"), F.col(f"_{i}").alias("value")) for i in (0, 1)])
    return pieces.select("piece", F.explode(lines).alias("_l")).select("_l.line", "piece", "_l.value")


def write_edges_wide(edges: DataFrame, path: str) -> None:
    """Children in folder ``line=0``, parents in ``line=1``; part files are in piece order, each row one piece."""
    lines = edges_wide(edges).repartitionByRange("line", "piece").sortWithinPartitions("line", "piece")
    lines.select("line", "value").write.partitionBy("line").text(path)
