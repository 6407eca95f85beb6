"""Cause search: beam over the slice lattice, choice of the causal cell, peeling.

A *problem* is one root cell in one minute. All problems are searched at once.
Every quantity the search needs is a sum over the problem's own lattice, whose
size is bounded by the catalogue, so one shuffle on ``pid`` per round is
enough: all windows below use partitionings that contain ``pid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import BEAM_WIDTH, DIMS, FREE_DIMS, MAX_CAUSES_PER_ROOT, MAX_DEPTH, ROOT_DIMS, SELECTION_TOLERANCE
from dipwatch.functions.cells import cell_key, matches
from dipwatch.functions.stats import DROP, rate, with_verdict
from dipwatch.session import stage

# Lattice coordinates: provider, method, issuer carry bits 4, 2, 1 of the mask.
AXES = {"p": 4, "m": 2, "i": 1}
SPECS = ("pm", "p", "", "mi", "m", "ip", "i")
PROBLEM = ["pid", "bucket", "minute", "root_expected", "delta_pp"]


def _mask_of(spec: str) -> int:
    return sum(AXES[a] for a in spec)


def residual(rows: DataFrame, problems: DataFrame, carved: DataFrame) -> DataFrame:
    """Root sums, verdict and deficit with the carved cells taken out.

    ``carved`` holds cells as ``cell_*`` columns keyed by ``pid``.
    """
    inside = _rows_of(rows, problems)
    kept = inside.join(carved, (inside["pid"] == carved["pid"]) & matches("cell_", ""), "left_anti")
    sums = problems.join(
        kept.groupBy("pid").agg(F.sum("attempts").alias("attempts"), F.sum("approved").alias("approved")), "pid", "left"
    ).fillna(0, ["attempts", "approved"])
    sums = with_verdict(sums, "approved", "attempts", "root_expected", "delta_pp")
    deficit = F.col("attempts") * F.col("root_expected") - F.col("approved")
    return sums.withColumn("rate", rate(F.col("approved"), F.col("attempts"))).withColumn(
        "deficit", F.greatest(F.lit(0.0), deficit)
    )


def _rows_of(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """Rollup rows of each problem: equal minute and root, inside its fixed cell."""
    asked = problems.select(*PROBLEM, *[F.col(d).alias(f"root_{d}") for d in DIMS])
    on = [rows["bucket"] == asked["bucket"]]
    on += [rows[d] == asked[f"root_{d}"] for d in ROOT_DIMS]
    on += [asked[f"root_{d}"].isNull() | (rows[d] == asked[f"root_{d}"]) for d in FREE_DIMS]
    return rows.drop("minute").join(asked, on, "inner").drop(rows["bucket"])


def lattice(rows: DataFrame, problems: DataFrame, coverage: DataFrame) -> DataFrame:
    """Skeleton of the search: one row per problem and lattice cell.

    The finest cells carry the measured rows (``base_*``); coarser cells are
    summed from them in every round, after the carved rows were zeroed.
    """
    base = _rows_of(rows, problems)
    free = sum(
        (F.when(F.col(f"root_{d}").isNull(), 4 >> i).otherwise(0) for i, d in enumerate(FREE_DIMS)), F.lit(0)
    )
    base = base.withColumn("free", free).withColumn(
        "mask", F.explode(F.filter(F.array(*map(F.lit, range(8))), lambda b: b.bitwiseAND(F.col("free")) == b))
    )
    finest = F.col("mask") == F.col("free")
    for axis, d in zip(AXES, FREE_DIMS):
        base = base.withColumn(axis, F.when(F.col("mask").bitwiseAND(AXES[axis]) != 0, F.col(d)))
    zero = F.lit(0).cast("bigint")
    cells = base.groupBy(*PROBLEM, *[f"root_{d}" for d in DIMS], "free", "mask", *AXES).agg(
        F.sum(F.when(finest, F.col("attempts")).otherwise(zero)).alias("base_n"),
        F.sum(F.when(finest, F.col("approved")).otherwise(zero)).alias("base_k"),
        F.sum(F.when(finest & (F.col("payment_method") != "CARD"), 1).otherwise(0)).alias("base_other"),
    )
    for axis, d in zip(AXES, FREE_DIMS):
        cells = cells.withColumn(d, F.coalesce(F.col(axis), F.col(f"root_{d}")))
    cells = cells.withColumn("merchant_id", F.col("root_merchant_id")).withColumn("country", F.col("root_country"))
    known_p = coverage.select("country", F.col("provider_id").alias("p"), F.lit(True).alias("known_p")).distinct()
    known_m = coverage.select("country", F.col("payment_method").alias("m"), F.lit(True).alias("known_m")).distinct()
    return (
        cells.join(known_p, ["country", "p"], "left")
        .join(known_m, ["country", "m"], "left")
        .withColumn("key", cell_key())
        .withColumn("depth", F.bit_count("mask"))
        .drop(*[f"root_{d}" for d in DIMS])
    )


def _over(spec: str) -> str:
    return "OVER (PARTITION BY " + ", ".join(["pid", *spec]) + ")"


def with_sums(cells: DataFrame) -> DataFrame:
    """Sums of every lattice cell and of its possible parents, from the kept rows.

    The order of ``SPECS`` lets one sort serve (pid,p,m), (pid,p) and (pid).
    """
    out = cells.repartition("pid")
    for spec in SPECS:
        out = out.withColumns({
            f"sum_{measure}_{spec}": F.expr(f"sum(base_{measure}) {_over(spec)}") for measure in ("n", "k", "other")
        })

    def own(measure: str) -> Column:
        cases = " ".join(f"WHEN {_mask_of(s)} THEN sum_{measure}_{s}" for s in SPECS)
        return F.expr(f"CASE mask {cases} ELSE base_{measure} END")

    return out.withColumns({"n": own("n"), "k": own("k")})


def _way(parent: str, axis: str, depth: int) -> str:
    """(rank of the parent, reference) of reaching a cell along ``axis``, null if barred.

    The reference is the parent without the cell. Only a slice that is card
    throughout can be compared bank by bank; other values must be covered.
    """
    rank = "0" if depth == 1 else f"beam_{parent}"
    allowed = f"sum_other_{parent} = 0" if axis == "i" else f"known_{axis}"
    reference = f"try_divide(cast(sum_k_{parent} - k AS double), cast(sum_n_{parent} - n AS double))"
    return (
        f"CASE WHEN {allowed} AND {rank} IS NOT NULL AND sum_n_{parent} > n"
        f" THEN named_struct('parent_rank', {rank}, 'reference', {reference}) END"
    )


def _spec_name(axes) -> str:
    return next(s for s in SPECS if sorted(s) == sorted(axes))


def with_beam(cells: DataFrame) -> DataFrame:
    """Three levels of beam search. Adds the reference of each reached cell and its verdict."""
    out = with_verdict(cells, "sum_k_", "sum_n_", "root_expected", "delta_pp", prefix="root_").withColumns({
        "explained": F.expr(
            "greatest(0D, sum_n_ * root_expected - sum_k_)"
            " - greatest(0D, (sum_n_ - n) * root_expected - (sum_k_ - k))"
        ),
        "searched": F.expr(f"root_state = '{DROP}' AND n > 0 AND mask > 0"),
        "expected": F.expr("cast(NULL AS double)"),
        "beam": F.expr("cast(NULL AS int)"),
    }).withColumn("concentration", F.expr("coalesce(try_divide(explained, n), 0D)"))
    for depth in range(1, MAX_DEPTH + 1):
        # A cell reached from several parents takes the best-ranked one that has
        # a reference: the smallest (rank, reference) pair.
        cases = []
        for mask in [m for m in range(1, 8) if m.bit_count() == depth]:
            axes = [a for a in AXES if mask & AXES[a]]
            ways = [_way(_spec_name([a for a in axes if a != axis]), axis, depth) for axis in axes]
            cases.append(f"WHEN {mask} THEN " + (ways[0] if len(ways) == 1 else f"least({', '.join(ways)})"))
        found = f"(CASE mask {' '.join(cases)} END)"
        out = out.withColumn(
            "expected", F.expr(f"CASE WHEN searched AND depth = {depth} THEN {found}.reference ELSE expected END")
        )
        if depth == MAX_DEPTH:
            break
        at_level = f"(depth = {depth} AND expected IS NOT NULL)"
        place = (
            f"row_number() OVER (PARTITION BY pid, {at_level}"
            " ORDER BY explained DESC, concentration DESC, key)"
        )
        out = out.withColumn("place", F.expr(place)).withColumn(
            "beam", F.expr(f"CASE WHEN {at_level} AND place <= {BEAM_WIDTH} THEN place ELSE beam END")
        )
        # Tell the children the rank of each cell that may be their parent.
        for spec in [s for s in SPECS if len(s) == depth]:
            rank = f"max(CASE WHEN mask = {_mask_of(spec)} THEN beam END) {_over(spec)}"
            out = out.withColumn(f"beam_{spec}", F.expr(rank))
    out = with_verdict(out, "k", "n", "expected", "delta_pp")
    return out.withColumn("admissible", F.expr(f"coalesce(state = '{DROP}' AND explained > 0, false)"))


def with_causal(cells: DataFrame) -> DataFrame:
    """Mark one causal cell per problem: densest, then largest, then simplest."""
    band = f"(1 - {SELECTION_TOLERANCE})"
    over = _over("")
    steps = {
        "_best": f"max(CASE WHEN admissible THEN concentration END) {over}",
        "_dense": f"admissible AND concentration >= _best * {band}",
        "_most": f"max(CASE WHEN _dense THEN explained END) {over}",
        "_large": f"_dense AND explained >= _most * {band}",
        "_first": f"min(CASE WHEN _large THEN struct(depth, key) END) {over}",
        "causal": "coalesce(_large AND key = _first.key, false)",
    }
    out = cells
    for name, text in steps.items():
        out = out.withColumn(name, F.expr(text))
    return out.drop("_best", "_dense", "_most", "_large", "_first")


def _carve(cells: DataFrame) -> DataFrame:
    """Zero the finest rows that lie inside the causal cell of their problem."""
    out = cells.withColumn("_cut", F.expr(f"max(CASE WHEN causal THEN struct(mask, p, m, i) END) {_over('')}"))
    inside = " AND ".join(f"(_cut.{a} IS NULL OR _cut.{a} = {a})" for a in AXES)
    hit = f"_cut IS NOT NULL AND mask = free AND {inside}"
    zeroed = {name: F.expr(f"CASE WHEN {hit} THEN 0L ELSE {name} END") for name in BASE}
    return out.withColumns({**zeroed, "found": F.expr("_cut IS NOT NULL")}).drop("_cut")


SKELETON = [*PROBLEM, *DIMS, "free", "mask", *AXES, "known_p", "known_m", "key", "depth"]
BASE = ["base_n", "base_k", "base_other"]
MEASURED = ["n", "k", "expected", "ci_low", "ci_high", "explained", "concentration", "admissible", "causal"]
CAUSE_COLUMNS = [*PROBLEM, *DIMS, "key", "depth", "peel_no", "attempts", "approved", "observed", "expected",
                 "ci_low", "ci_high", "explained", "concentration"]
ECHO_COLUMNS = ["pid", "peel_no", *DIMS, "key", "observed", "residual_rate"]


def candidates(rows: DataFrame, problems: DataFrame, coverage: DataFrame) -> DataFrame:
    """All reached cells of a first round, causal one marked. One search, no peeling."""
    return with_causal(with_beam(with_sums(lattice(rows, problems, coverage)))).where(F.col("expected").isNotNull())


def peel(rows: DataFrame, problems: DataFrame, coverage: DataFrame,
         rounds: int = MAX_CAUSES_PER_ROOT) -> tuple[DataFrame, DataFrame]:
    """Peel causes one at a time, for all problems together.

    Each round is one staged table over the problems still standing. The echoes
    of a round are read in the next one, where the sums without its cause exist
    anyway. Returns ``(causes, echoes)``.
    """
    current = stage(lattice(rows, problems, coverage), "lattice")
    causes, echoes = [], []
    for number in range(1, rounds + 2):
        work = with_sums(current)
        if number > 1:
            work = with_verdict(work, "k", "n", "was_expected", "delta_pp", prefix="echo_")
        if number <= rounds:
            work = _carve(with_causal(with_beam(work)))
        else:
            work = work.withColumn("found", F.lit(False))
            for name in MEASURED[2:]:
                kind = "boolean" if name in ("admissible", "causal") else "double"
                work = work.withColumn(name, F.lit(None).cast(kind))
        kept = [*SKELETON, *BASE, *MEASURED, "found"]
        if number > 1:
            kept += ["was_admissible", "was_causal", "was_observed", "echo_state"]
        done = stage(work.select(*kept), f"peel{number}")
        if number > 1:
            echoes.append(
                done.where(F.col("was_admissible") & ~F.col("was_causal") & (F.col("echo_state") != DROP)).select(
                    "pid", F.lit(number - 1).alias("peel_no"), *DIMS, "key", F.col("was_observed").alias("observed"),
                    rate(F.col("k"), F.col("n")).alias("residual_rate"),
                )
            )
        if number <= rounds:
            causes.append(
                done.where("causal").withColumn("peel_no", F.lit(number)).withColumn("attempts", F.col("n"))
                .withColumn("approved", F.col("k"))
                .withColumn("observed", F.coalesce(rate(F.col("k"), F.col("n")), F.lit(0.0)))
                .select(*CAUSE_COLUMNS)
            )
            standing = done.where("found")
            if standing.isEmpty():
                break
            current = standing.select(
                *SKELETON, *BASE, F.col("admissible").alias("was_admissible"), F.col("causal").alias("was_causal"),
                F.coalesce(rate(F.col("k"), F.col("n")), F.lit(0.0)).alias("was_observed"),
                F.col("expected").alias("was_expected"),
            )
    all_causes, all_echoes = causes[0], echoes[0] if echoes else None
    for more in causes[1:]:
        all_causes = all_causes.unionByName(more)
    for more in echoes[1:]:
        all_echoes = all_echoes.unionByName(more)
    if all_echoes is None:
        all_echoes = causes[0].where(F.lit(False)).withColumn("residual_rate", F.lit(None).cast("double")).select(*ECHO_COLUMNS)
    return all_causes, all_echoes
