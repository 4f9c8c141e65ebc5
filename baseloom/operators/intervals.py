"""Intervals on chunked sequences: slices, coding sequences, introns, flanks.

``chunks`` is a table of chunks or a ``ChunkStore``. With a store the join reads the bases where they lie, only intervals move, and
intervals are clipped by the dimension of sequences before they are laid out over chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.functions.sequence import ADDITIVE_COUNTS, gc_fraction, orient, with_base_counts
from baseloom.sources.chunk_store import ChunkStore

SITE = ["genome_pk", "sequence_id"]

# Bases of one block of chunks, unless a single chunk is longer.
BLOCK_BP = 32_768

# Bases of half a block of the lowest level in `slice_intervals`, unless a single chunk is longer.
HALF_BP = 4_096

# Flank sets as (key, name, upstream bases, downstream bases).
FLANK_SETS = [
    (1, "50_up_50_down", 50, 50),
    (2, "100_up_100_down", 100, 100),
    (3, "200_up_200_down", 200, 200),
]


def located_on(chunks: DataFrame | ChunkStore, intervals: DataFrame) -> DataFrame:
    """The intervals on sequences that have bases."""
    if isinstance(chunks, ChunkStore):
        return intervals.join(chunks.sequences.select(*SITE), SITE, "left_semi")
    # Each sequence has exactly one first chunk.
    return intervals.join(chunks.where(F.col("chunk_no") == 0).select(*SITE), SITE, "left_semi")


def slice_pieces(chunks: DataFrame | ChunkStore, intervals: DataFrame, chunk_bp: int) -> DataFrame:
    """The part of each interval that lies on each chunk, as an equi-join.

    ``intervals`` has ``genome_pk, sequence_id, start, end`` (1-based, both
    ends included). Intervals are clipped to the sequence: what lies beyond it
    meets no chunk. Adds ``chunk_no`` and ``piece``; an interval without bases
    gives no row.
    """
    bases, wanted, stop = chunks, intervals, F.col("end")
    if isinstance(chunks, ChunkStore):
        bases = chunks.bases
        wanted = intervals.join(chunks.sequences.select(*SITE, F.col("sequence_length").alias("_bp")), SITE)
        stop = F.least("end", "_bp")
    first = F.floor((F.greatest("start", F.lit(1)) - 1) / chunk_bp).cast("bigint")
    last = F.floor((stop - 1) / chunk_bp).cast("bigint")
    hit = (
        wanted.where((stop >= F.col("start")) & (F.col("end") >= 1))
        .withColumn("chunk_no", F.explode(F.sequence(first, last)))
        .drop("_bp")
        .join(bases.select(*SITE, "chunk_no", "bases"), [*SITE, "chunk_no"])
    )
    base = F.col("chunk_no") * chunk_bp
    lo = F.greatest(F.col("start") - base, F.lit(1))
    hi = F.least(F.col("end") - base, F.length("bases"))
    return (
        hit.where(hi >= lo)
        .withColumn("piece", F.substring("bases", lo.cast("int"), (hi - lo + 1).cast("int")))
        .drop("bases")
    )


def join_pieces(pieces: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Glue pieces together in order; a group is one interval or one gene."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "piece")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("seq"))


def slice_intervals(chunks: DataFrame | ChunkStore, intervals: DataFrame, chunk_bp: int, keys: list[str]) -> DataFrame:
    """Strand-oriented bases of each interval; ``keys`` are columns that go along.

    An interval is cut whole from one block of chunks, so its text is neither moved nor glued. Blocks overlap by half and
    double in length from level to level; an interval goes to the lowest level where it is no longer than half a block, so
    some block there holds it, and no block is longer than four of its intervals or the smallest block. Of a block only the
    chunks that its intervals reach are gathered: a chunk moves at most twice per level, however many intervals lie on it.
    Intervals on unknown sequences are left out; those that lie wholly beyond the ends give the empty text. Rows may repeat.
    """
    given = list(dict.fromkeys([*keys, *SITE, "strand", "start", "end"]))
    block = [*SITE, "_level", "_block"]
    half = max(1, HALF_BP // chunk_bp)
    start, end = F.col("start"), F.col("end")
    stop = F.least(end, "_bp")
    first = F.floor((F.greatest(start, F.lit(1)) - 1) / chunk_bp).cast("bigint")
    last = F.floor((stop - 1) / chunk_bp).cast("bigint")
    placed = (
        intervals.select(*given)
        .join(_extents(chunks, chunk_bp), SITE)
        .withColumns({"_first": F.when((stop >= start) & (end >= 1), first), "_last": last})
        .withColumn("_halves", F.expr(f"(_last - _first) div {half}"))
        .withColumn("_level", F.when(F.col("_halves") > 0, F.length(F.bin("_halves"))).otherwise(F.lit(0)))
        .withColumn("_block", F.expr(f"_first div ({half} * shiftleft(1L, _level))"))
        .drop("_halves")
    )
    wanted = placed.where("_block IS NOT NULL").groupBy(*block).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    wanted = wanted.select(*block, F.explode(F.sequence("_first", "_last")).alias("chunk_no"))
    bases = chunks.bases if isinstance(chunks, ChunkStore) else chunks
    gathered = bases.select(*SITE, "chunk_no", "bases").join(wanted, [*SITE, "chunk_no"]).groupBy(*block).agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "bases"))).alias("_chunks")
    )
    numbers = F.transform("_chunks", lambda c: c["chunk_no"])
    at = F.get("_chunks", F.lit(0))["chunk_no"]
    # The first number if each number up to the last is there once: then a chunk's place is known.
    whole = (F.element_at(numbers, -1) - at + 1 == F.size(numbers)) & (F.size(F.array_distinct(numbers)) == F.size(numbers))
    gathered = gathered.withColumn("_base", F.when(whole, at))
    place = (F.col("_first") - F.col("_base") + 1).cast("int")
    near = F.slice("_chunks", place, (F.col("_last") - F.col("_first") + 1).cast("int"))
    among = F.when(F.col("_first") >= F.col("_base"), near).otherwise(F.col("_chunks"))
    cut = placed.join(gathered, block, "left").withColumn("seq", _cut_of(start, end, chunk_bp, among))
    return cut.withColumn("seq", orient(F.col("seq"), F.col("strand"))).select(*given, "seq")


def _extents(chunks: DataFrame | ChunkStore, chunk_bp: int) -> DataFrame:
    """The sequences that have bases, with a bound ``_bp`` of their length."""
    if isinstance(chunks, ChunkStore):
        return chunks.sequences.select(*SITE, F.col("sequence_length").alias("_bp"))
    ends = chunks.groupBy(*SITE).agg(F.min("chunk_no").alias("_low"), ((F.max("chunk_no") + 1) * chunk_bp).alias("_bp"))
    return ends.where("_low = 0").drop("_low")


def _cut_of(start: Column, end: Column, chunk_bp: int, among: Column | str = "_chunks") -> Column:
    """Bases from ``start`` to ``end`` in the gathered chunks of a row, glued in order; empty where there are none."""
    stop = F.least(end, "_bp")
    first = F.floor((F.greatest(start, F.lit(1)) - 1) / chunk_bp)
    last = F.floor((stop - 1) / chunk_bp)

    def low(c: Column) -> Column:
        return F.greatest(start - c["chunk_no"] * chunk_bp, F.lit(1))

    def high(c: Column) -> Column:
        return F.least(end - c["chunk_no"] * chunk_bp, F.length(c["bases"]))

    def piece(c: Column) -> Column:
        text = c["bases"].substr(low(c).cast("int"), (high(c) - low(c) + 1).cast("int"))
        return F.struct(c["chunk_no"].alias("chunk_no"), text.alias("piece"))

    hit = F.filter(among, lambda c: (c["chunk_no"] >= first) & (c["chunk_no"] <= last) & (high(c) >= low(c)))
    glued = F.array_join(F.transform(F.array_sort(F.transform(hit, piece)), lambda p: p["piece"]), "")
    return F.coalesce(F.when((stop >= start) & (end >= 1), glued), F.lit(""))


def cut_spans(
    chunks: DataFrame | ChunkStore, intervals: DataFrame, chunk_bp: int, spans: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """Rows with the bases of spans (name: start, end) on their sequence, plus strand, beside all their columns.

    Chunks are gathered to blocks, and a row goes to the block it lies on: there it is cut whole, so no base that was cut
    moves and nothing is looked up by key. Only rows that reach over several blocks are glued, by all their columns. Rows on
    unknown sequences are left out; spans that lie wholly beyond the ends give the empty text. Rows may repeat.
    """
    per_block = max(1, BLOCK_BP // chunk_bp)
    bases = chunks.bases if isinstance(chunks, ChunkStore) else chunks
    blocks = bases.groupBy(*SITE, F.floor(F.col("chunk_no") / per_block).alias("_block")).agg(
        F.collect_list(F.struct("chunk_no", "bases")).alias("_chunks")
    )
    # Bounds may be missing: least and greatest pass over nulls.
    low = F.greatest(F.least(*[s for s, _ in spans.values()], F.lit(None)), F.lit(1))
    high = F.least(F.greatest(*[e for _, e in spans.values()], F.lit(None)), "_bp")
    given = intervals.columns
    located = intervals.join(_extents(chunks, chunk_bp), SITE).withColumns(
        {
            "_block": F.when(high >= low, F.floor((low - 1) / (chunk_bp * per_block))),
            "_to": F.when(high >= low, F.floor((high - 1) / (chunk_bp * per_block))),
        }
    )
    texts = [_cut_of(start, end, chunk_bp).alias(name) for name, (start, end) in spans.items()]
    within = located.where(F.col("_block").eqNullSafe(F.col("_to"))).join(blocks, [*SITE, "_block"], "left").select(*given, *texts)
    over = (
        located.where("_block < _to")
        .withColumn("_block", F.explode(F.sequence("_block", "_to")))
        .join(blocks, [*SITE, "_block"], "left")
        .select(*given, "_block", *texts)
        .groupBy(*given)
        .agg(F.array_sort(F.collect_set(F.struct("_block", *spans))).alias("_parts"), F.count(F.lit(1)).alias("_n"))
        # Equal rows fell together here.
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_n") / F.size("_parts")).cast("int"))))
        .select(*given, *[F.array_join(F.col("_parts")[name], "").alias(name) for name in spans])
    )
    return within.unionByName(over)


def explode_exons(models: DataFrame) -> DataFrame:
    """One row per exon; the position follows the sorted starts."""
    kept = [c for c in models.columns if c not in ("exons", "start", "end")]
    return models.select(*kept, F.posexplode("exons").alias("exon_no", "_e")).select(
        *kept, "exon_no", F.col("_e.start").alias("start"), F.col("_e.end").alias("end")
    )


def extract_cds(models: DataFrame, chunks: DataFrame | ChunkStore, chunk_bp: int) -> DataFrame:
    """Coding sequence of each ``Single`` gene.

    Exons are joined from low to high and turned round on the minus strand.
    Models whose ``valid`` flag is false (a bad token or an exon on the other
    strand) and genes on unknown sequences are left out.
    """
    key = ["genome_pk", "gene"]
    chosen = models.where(F.col("status") == "Single")
    if "valid" in models.columns:
        chosen = chosen.where("valid")
    located = located_on(chunks, chosen)
    pieces = slice_pieces(chunks, explode_exons(located).select(*key, *SITE, "exon_no", "start", "end"), chunk_bp)
    glued = join_pieces(pieces, key, ["exon_no", "chunk_no"])
    return (
        located.select(*key, "sequence_id", "strand")
        .join(glued, key, "left")
        .withColumn("seq", orient(F.coalesce("seq", F.lit("")), F.col("strand")))
    )


def infer_introns(models: DataFrame) -> DataFrame:
    """Gaps between neighbouring exons, numbered in transcript order.

    The exons of one gene are one small array, so this needs no shuffle.
    """
    kept = [c for c in models.columns if c not in ("exons", "start", "end")]
    gaps = F.expr(
        """filter(transform(sequence(1, greatest(size(exons) - 1, 1)), i -> named_struct(
             'start', exons[i - 1].end + 1,
             'end', get(exons, i).start - 1)), g -> g.end IS NOT NULL AND g.start <= g.end)"""
    )
    ordered = F.when(F.col("strand") == "-", F.reverse("_gaps")).otherwise(F.col("_gaps"))
    return (
        models.where(F.size("exons") > 1)
        .withColumn("_gaps", gaps)
        .select(*kept, F.posexplode(ordered).alias("_place", "_g"))
        .select(
            *kept,
            (F.col("_place") + 1).cast("bigint").alias("intron_no"),
            F.concat(F.lit("i_"), "gene", F.lit("_"), F.col("_place") + 1).alias("intron_id"),
            F.col("_g.start").cast("bigint").alias("start"),
            F.col("_g.end").cast("bigint").alias("end"),
            (F.col("_g.end") - F.col("_g.start") + 1).cast("bigint").alias("length"),
        )
    )


def _measured(chunks: DataFrame | ChunkStore, located: DataFrame, chunk_bp: int, keys: list[str], text: bool) -> DataFrame:
    """Base counts per interval by adding up its pieces, and with ``text`` its bases, from one join with the chunks."""
    pieces = slice_pieces(chunks, located.select(*keys, *SITE, "start", "end"), chunk_bp)
    counted = with_base_counts(pieces.select(*keys, "chunk_no", "piece"), F.col("piece"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "piece")))
    glued = [F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("seq")] if text else []
    return counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ADDITIVE_COUNTS], *glued)


def _swap_on_minus(df: DataFrame) -> DataFrame:
    """Counts of the other strand: complementary bases change places."""
    minus = F.col("strand") == "-"
    pairs = [("a_count", "t_count"), ("c_count", "g_count")]
    out = {}
    for x, y in pairs:
        out[x] = F.when(minus, F.col(y)).otherwise(F.col(x))
        out[y] = F.when(minus, F.col(x)).otherwise(F.col(y))
    return df.withColumns(out)


def intron_counts(introns: DataFrame, chunks: DataFrame | ChunkStore, chunk_bp: int, empty_gc: float | None = None, text: bool = False) -> DataFrame:
    """Base counts and GC of each intron, without building its text unless ``text`` asks for ``seq``.

    ``empty_gc`` is the GC of an intron without callable bases. Introns on
    unknown sequences are left out.
    """
    key = ["genome_pk", "intron_id"]
    located = located_on(chunks, introns)
    counted = located.join(_measured(chunks, located, chunk_bp, key, text), key, "left").fillna(0, ADDITIVE_COUNTS)
    acgt = F.col("a_count") + F.col("c_count") + F.col("g_count") + F.col("t_count")
    gc = gc_fraction(F.col("g_count") + F.col("c_count"), acgt)
    out = _swap_on_minus(
        counted.withColumn("total_valid_bases", acgt).withColumn("gc", F.coalesce(gc, F.lit(empty_gc).cast("double")))
    ).drop("gap_bp", "total_bp")
    return out.withColumn("seq", orient(F.coalesce("seq", F.lit("")), F.col("strand"))) if text else out


def extract_introns(introns: DataFrame, chunks: DataFrame | ChunkStore, chunk_bp: int) -> DataFrame:
    """Introns with sequence, counts and GC (0 without callable bases)."""
    return intron_counts(introns, chunks, chunk_bp, empty_gc=0.0, text=True)


def flank_intervals(models: DataFrame) -> DataFrame:
    """Upstream and downstream intervals of each gene for each flank set.

    The low end is clipped at 1; the reported high end is not clipped.
    """
    sets = F.array(
        *[
            F.struct(F.lit(k).cast("bigint").alias("flank_set_pk"), F.lit(u).alias("_up"), F.lit(dn).alias("_down"))
            for k, _, u, dn in FLANK_SETS
        ]
    )
    plus = F.col("strand") == "+"
    left = F.when(plus, F.col("_up")).otherwise(F.col("_down"))
    right = F.when(plus, F.col("_down")).otherwise(F.col("_up"))
    low = (F.greatest(F.lit(1), F.col("start") - left), F.col("start") - 1)
    high = (F.col("end") + 1, F.col("end") + right)

    def pick(a: Column, b: Column) -> Column:
        return F.when(plus, a).otherwise(b).cast("bigint")

    kept = [c for c in models.columns if c not in ("exons",)]
    return (
        models.where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .select(*kept, F.inline(sets))
        .withColumns(
            {
                "up_start": pick(low[0], high[0]),
                "up_end": pick(low[1], high[1]),
                "down_start": pick(high[0], low[0]),
                "down_end": pick(high[1], low[1]),
            }
        )
        .drop("_up", "_down")
    )


def extract_flanks(models: DataFrame, chunks: DataFrame | ChunkStore, chunk_bp: int) -> DataFrame:
    """GC over both flanks and of each; length is the callable bases.

    Strands need no text here: GC is the same on both.
    """
    key = ["genome_pk", "gene", "flank_set_pk"]
    located = located_on(chunks, flank_intervals(models))
    sides = located.select(
        *key,
        *SITE[1:],
        F.inline(
            F.array(
                F.struct(F.lit("up").alias("side"), F.col("up_start").alias("start"), F.col("up_end").alias("end")),
                F.struct(F.lit("down").alias("side"), F.col("down_start").alias("start"), F.col("down_end").alias("end")),
            )
        ),
    )
    gc = F.col("g_count") + F.col("c_count")
    pieces = with_base_counts(slice_pieces(chunks, sides, chunk_bp).select(*key, "side", "piece"), F.col("piece")).select(
        *key, "side", gc.alias("gc"), (gc + F.col("a_count") + F.col("t_count")).alias("acgt")
    )

    def total(name: str, side: str | None = None) -> Column:
        value = F.col(name) if side is None else F.when(F.col("side") == side, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0))

    summed = pieces.groupBy(*key).agg(
        gc_fraction(total("gc"), total("acgt")).alias("gc"),
        total("acgt").alias("length"),
        gc_fraction(total("gc", "up"), total("acgt", "up")).alias("upstream_gc"),
        gc_fraction(total("gc", "down"), total("acgt", "down")).alias("downstream_gc"),
    )
    return located.join(summed, key, "left").fillna(0, ["length"])


def validate_introns(reported: DataFrame, chunks: DataFrame | ChunkStore, chunk_bp: int, boundary: int = 0) -> DataFrame:
    """Cut each reported intron again and compare length and bases.

    ``reported`` has ``genome_pk, intron_id, sequence_id, strand, start, end,
    length, seq``, and each of its rows is checked for itself. With ``boundary``
    the bases around both ends are added.
    """
    key = ["genome_pk", "intron_id"]
    start, end = F.col("start"), F.col("end")
    spans = {"expected": (start, end)}
    if boundary > 0:
        spans["left_boundary_sequence"] = (F.greatest(F.lit(1), start - boundary), start + boundary - 1)
        spans["right_boundary_sequence"] = (F.greatest(F.lit(1), end - boundary + 1), end + boundary)
    asked = reported.where(F.col("intron_id").isNotNull()).select(
        *key, "sequence_id", "strand", "start", "end", "length", F.upper("seq").alias("seq")
    )
    cut = cut_spans(chunks, asked, chunk_bp, spans).withColumn("expected", F.upper(orient(F.col("expected"), F.col("strand"))))
    expected_bp = end - start + 1
    return cut.select(
        *key,
        F.col("length").alias("reported_length"),
        expected_bp.alias("expected_length"),
        F.length("seq").cast("bigint").alias("reported_sequence_length"),
        (expected_bp == F.col("length")).alias("length_math_ok"),
        (F.length("seq") == expected_bp).alias("sequence_length_match"),
        (F.col("seq") == F.col("expected")).alias("sequence_match"),
        F.left("seq", F.lit(20)).alias("reported_first_20"),
        F.left("expected", F.lit(20)).alias("expected_first_20"),
        F.right("seq", F.lit(20)).alias("reported_last_20"),
        F.right("expected", F.lit(20)).alias("expected_last_20"),
        *[n for n in spans if n != "expected"],
    )


def validation_summary(checked: DataFrame) -> DataFrame:
    """How many introns were checked and how many agree."""
    return checked.agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if("sequence_match").alias("n_sequence_match"),
        F.count_if("length_math_ok").alias("n_length_math_ok"),
        F.count_if("sequence_length_match").alias("n_sequence_length_match"),
        F.count_if(~F.col("sequence_match")).alias("n_mismatch"),
    )
