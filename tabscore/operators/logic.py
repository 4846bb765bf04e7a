"""Cross-column logic: functional dependencies, hierarchies, equations, and the search for dependencies."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.canon import canon, ratio
from tabscore.functions.stable import stable
from tabscore.operators.order import row_numbers  # noqa: F401  (its name here is public)
from tabscore.operators.schema import DataSchema
from tabscore.operators.specs import OPERATORS, LogicSpec

EPS, REGULARISER, NEAR_ZERO = 1e-3, 1e-9, 1e-9
MAX_DETERMINANTS, MIN_ROWS = 1000, 30
log = logging.getLogger(__name__)


def text_of(df: DataFrame, column: str, missing: str | None = "nan") -> Column:
    return canon(F.col(f"`{column}`"), df.schema[column].dataType, missing)


def fd_mapping(real: DataFrame, det: str, dep: str) -> DataFrame:
    """(det, dep): each determinant's most frequent dependent value, the smallest of several; nulls take no part."""
    pairs = real.select(text_of(real, det, None).alias("det"), text_of(real, dep, None).alias("dep")).filter("det is not null and dep is not null")
    counts = pairs.groupBy("det", "dep").agg(F.count("*").alias("n"))
    # The smallest of the most frequent: the largest count and, by the order reversed, the least text.
    return counts.groupBy("det").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("dep"))).alias("x")).select("det", F.col("x.dep").alias("dep"))


def fd_softness(real: DataFrame, det: str, dep: str) -> DataFrame:
    """(n_det, n_soft, softness): the share of determinants with several dependent values."""
    pairs = real.select(text_of(real, det, None).alias("det"), text_of(real, dep, None).alias("dep")).filter("det is not null").distinct()
    per = pairs.groupBy("det").agg(F.count("dep").alias("k"))
    return per.agg(F.count("*").alias("n_det"), F.count(F.when(F.col("k") > 1, 1)).alias("n_soft")).withColumn("softness", ratio(F.col("n_soft"), F.col("n_det")))


#: Rows and bytes of a lookup table that is sent to every task; a larger one is joined by a shuffle.
LOOKUP_ROWS, LOOKUP_BYTES = 100_000, 16 << 20


def _lookup(table: DataFrame) -> DataFrame:
    """table, of texts, as one that is sent to every task if it is known to be small: its rows and bytes are counted first."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in table.columns), F.lit(0))
    n, held = table.select(size.alias("s")).agg(F.count("*"), F.sum("s")).first()
    return F.broadcast(table) if n <= LOOKUP_ROWS and (held or 0) <= LOOKUP_BYTES else table


def fd_flags(real: DataFrame, synth: DataFrame, fds: list[tuple[str, str]]) -> DataFrame:
    """synth with a boolean column fd_i for each dependency: its determinant is known and implies another value.

    Small mappings meet synth where its rows lie; only one with more than LOOKUP_ROWS determinants shuffles it.
    """
    out = synth
    for i, (det, dep) in enumerate(fds):
        m = stable(fd_mapping(real, det, dep).select(F.col("det").alias(f"_det{i}"), F.col("dep").alias(f"_dep{i}")))
        out = out.join(_lookup(m), text_of(synth, det, None) == F.col(f"_det{i}"), "left")
        out = out.withColumn(f"fd_{i}", F.col(f"_dep{i}").isNotNull() & (text_of(synth, dep) != F.col(f"_dep{i}"))).drop(f"_det{i}", f"_dep{i}")
    return out


def hierarchy_flags(real: DataFrame, synth: DataFrame, chains: list[list[str]]) -> DataFrame:
    """synth with a boolean column chain_i for each hierarchy: a pair of neighbours isn't in the real table."""
    out = synth
    for i, chain in enumerate(chains):
        bad = []
        for j, (up, down) in enumerate(zip(chain, chain[1:], strict=False)):
            names = [f"_{x}{i}_{j}" for x in ("up", "down", "in")]
            known = stable(real.select(text_of(real, up).alias(names[0]), text_of(real, down).alias(names[1])).distinct()).withColumn(names[2], F.lit(True))
            out = out.join(_lookup(known), (text_of(synth, up) == F.col(names[0])) & (text_of(synth, down) == F.col(names[1])), "left").drop(*names[:2])
            bad.append(F.col(names[2]).isNull())
        out = out.withColumn(f"chain_{i}", reduce(or_, bad) if bad else F.lit(False)).drop(*[f"_in{i}_{j}" for j in range(len(chain) - 1)])
    return out


def flag_rates(flagged: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """(key, n_violations, value) of each flag, and of any of them under 'overall'; the denominator is all rows."""
    flags = {n: F.col(f"{prefix}_{i}") for i, n in enumerate(names)} | {"overall": reduce(or_, [F.col(f"{prefix}_{i}") for i in range(len(names))])}
    row = flagged.agg(F.count("*").alias("n"), *[F.count(F.when(f, 1)).alias(f"c{i}") for i, f in enumerate(flags.values())])
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"c{i}").alias("n_violations"), ratio(F.col(f"c{i}"), F.col("n")).alias("value")) for i, k in enumerate(flags)])
    return row.select(F.inline(cells))


#: kind -> build(real, *arguments), which returns a boolean column: the row of the synthetic table breaks the constraint.
CONSTRAINTS: dict[str, Callable[..., Column]] = {}


def register_constraint(kind: str, build: Callable[..., Column]) -> None:
    CONSTRAINTS[kind] = build


def constraint_rates(real: DataFrame, synth: DataFrame, constraints: list[tuple]) -> DataFrame:
    """(key, n_violations, value) of each constraint and of any of them, as for dependencies; null counts as kept."""
    unknown = sorted({c[0] for c in constraints} - set(CONSTRAINTS))
    if unknown:
        raise ValueError(f"no constraint is called {unknown}; there are {sorted(CONSTRAINTS)}")
    flags = {f"rule_{i}": F.coalesce(CONSTRAINTS[kind](real, *args), F.lit(False)) for i, (kind, *args) in enumerate(constraints)}
    return flag_rates(synth.withColumns(flags), "rule", [f"{kind}({', '.join(map(str, args))})" for kind, *args in constraints])


def equation_error(a: str, op: str, b: str, c: str) -> Column:
    """|a op b - c| / (|c| + regulariser); null if an operand is, or a divisor is near zero."""
    x, y, z = (F.col(f"`{v}`").try_cast("double") for v in (a, b, c))
    left = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(F.abs(y) >= NEAR_ZERO, x / F.when(F.abs(y) >= NEAR_ZERO, y))}[op]
    return F.abs(left - z) / (F.abs(z) + REGULARISER)


def mdi_per_equation(df: DataFrame, equations: list[tuple[str, str, str, str]], eps: float = EPS) -> DataFrame:
    """(key, n_valid, value): the share of the rows with an error above eps among those where it is defined."""
    known = [e for e in equations if e[1] in OPERATORS]
    row = df.agg(*[f(equation_error(*e)).alias(f"{t}{i}") for i, e in enumerate(known) for t, f in (("n", F.count), ("bad", lambda x: F.count(F.when(x > eps, 1))))])
    name = lambda e: f"{e[0]} {e[1]} {e[2]} = {e[3]}"
    return row.select(F.inline(F.array(*[F.struct(F.lit(name(e)).alias("key"), F.col(f"n{i}").alias("n_valid"), ratio(F.col(f"bad{i}"), F.col(f"n{i}")).alias("value")) for i, e in enumerate(known)])))


def fd_scan(df: DataFrame, columns: list[str], max_determinants: int = MAX_DETERMINANTS, min_rows: int = MIN_ROWS) -> DataFrame:
    """(det, dep) of all dependencies that hold without exception, in the order of columns.

    A determinant has 2 to max_determinants values. One count of distinct values decides which columns are tried; the
    pairs of those are then tested together, on pre-aggregated (pair, det, dep) cells.
    """
    texts = df.select(*[text_of(df, c, None).alias(f"c{i}") for i, c in enumerate(columns)])
    about = texts.agg(F.count("*").alias("n"), *[F.approx_count_distinct(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).first()
    near = [i for i in range(len(columns)) if about["n"] >= min_rows and about[f"c{i}"] <= 1.5 * max_determinants]
    schema = "position int, det string, dep string"
    if not near:
        return df.sparkSession.createDataFrame([], schema).select("det", "dep")
    cells = F.array(*[F.struct(F.lit(i * len(columns) + j).alias("pair"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i in near for j in range(len(columns)) if i != j])
    seen = texts.select(F.inline(cells)).filter("x is not null").groupBy("pair", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    held = seen.groupBy("pair").agg(F.count("*").alias("n"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("many"))
    held = held.filter((F.col("n") >= 2) & (F.col("n") <= max_determinants) & (F.col("many") == 0))
    names = F.array(*[F.lit(c) for c in columns])
    width = len(columns)
    return held.select(F.col("pair").alias("position"), F.get(names, (F.col("pair") / width).cast("int")).alias("det"), F.get(names, F.col("pair") % width).alias("dep")).orderBy("position").select("det", "dep")


def discover_fds(real_df: DataFrame, schema: DataSchema | None = None, max_unique_determinant: int = MAX_DETERMINANTS, min_rows: int = MIN_ROWS) -> list[tuple[str, str]]:
    columns = schema.column_names if schema else real_df.columns
    return [(r["det"], r["dep"]) for r in fd_scan(real_df, columns, max_unique_determinant, min_rows).collect()]


def partitions_of(codes: np.ndarray) -> np.ndarray:
    """The class of each row by its codes."""
    return np.unique(codes, axis=0, return_inverse=True)[1].reshape(-1)


def composite_fds(df: DataFrame, columns: list[str], most: int = 3, sample_rows: int = 5_000) -> list[tuple[tuple[str, ...], str]]:
    """All minimal dependencies (determinants, dependent) of up to `most` determinants that hold in every row of df.

    Level by level, from one determinant on. A dependency that sample_rows rows break is dropped there and then, by the
    classes into which their determinants part them. What is left is tested on all rows: a set of columns has as many
    distinct tuples with the dependent as without it, if it determines it. All sets of a level are counted by one job,
    on hashes of 128 bits of the tuples. Sets that hold aren't extended, and neither are keys, which determine all.
    Missing values are values here: equal to each other.
    """
    n = len(columns)
    rows = df.select(*[F.coalesce(F.concat(F.lit("+"), text_of(df, c, None)), F.lit("-")).alias(f"c{i}") for i, c in enumerate(columns)])
    small = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(sample_rows).toArrow()
    codes = np.stack([np.unique(small.column(i).to_numpy(zero_copy_only=False), return_inverse=True)[1] for i in range(n)], axis=1) if small.num_rows else np.empty((0, n), int)
    known: dict[frozenset[int], int] = {}

    def count(sets: set[frozenset[int]]) -> None:
        new = sorted((s for s in sets if s not in known), key=sorted)
        if not new:
            return
        tuples = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(*[f"c{i}" for i in sorted(s)]).alias("h"), F.xxhash64(F.lit(1), *[f"c{i}" for i in sorted(s)]).alias("g")) for k, s in enumerate(new)])
        found = rows.select(F.inline(tuples)).groupBy("k", "h", "g").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("n")).collect()
        known.update({s: 0 for s in new} | {new[r["k"]]: r["n"] for r in found})

    out: list[tuple[tuple[int, ...], int]] = []
    total = rows.count()
    if not total:
        return []
    keys: list[frozenset[int]] = []
    for size in range(1, most + 1):
        tried = []
        for dets in combinations(range(n), size):
            if any(k <= set(dets) and len(k) < size for k in keys):
                continue
            classes = partitions_of(codes[:, list(dets)])
            for dep in range(n):
                if dep in dets or any(dep == d and set(s) <= set(dets) for s, d in out):
                    continue
                if len(np.unique(np.stack([classes, codes[:, dep]]), axis=1).T) == classes.max(initial=-1) + 1:
                    tried.append((dets, dep))
        count({frozenset(s) for s, _ in tried} | {frozenset((*s, d)) for s, d in tried})
        out += [(s, d) for s, d in tried if known[frozenset(s)] == known[frozenset((*s, d))]]
        keys += [frozenset(s) for s, _ in tried if known[frozenset(s)] == total]
    return [(tuple(columns[i] for i in s), columns[d]) for s, d in out]


def fd_violation_rate(df: DataFrame, det: str, dep: str, min_support: int = 10) -> DataFrame:
    """(n_groups, n_violating, value) over the determinants with min_support rows at least."""
    pairs = df.select(text_of(df, det, None).alias("det"), text_of(df, dep, None).alias("dep")).filter("det is not null and dep is not null").groupBy("det", "dep").agg(F.count("*").alias("n"))
    per = pairs.groupBy("det").agg(F.sum("n").alias("n"), F.count("*").alias("k")).filter(F.col("n") >= min_support)
    return per.agg(F.count("*").alias("n_groups"), F.count(F.when(F.col("k") > 1, 1)).alias("n_violating")).withColumn("value", ratio(F.col("n_violating"), F.col("n_groups")))


@dataclass
class Dim2Result:
    icvr: dict[str, float] = field(default_factory=dict)
    icvr_overall: float | None = None
    hcs: dict[str, float] = field(default_factory=dict)
    hcs_overall: float | None = None
    mdi: dict[str, float] = field(default_factory=dict)
    mdi_mean: float | None = None
    real_ll: float | None = None
    synth_ll: float | None = None
    dsi_gap: float | None = None
    constraints: dict[str, float] = field(default_factory=dict)
    constraints_overall: float | None = None

    @property
    def dsi_relative_gap(self) -> float | None:
        return self.dsi_gap / abs(self.real_ll) * 100 if self.dsi_gap is not None and self.real_ll else None

    @property
    def summary(self) -> str:
        return f"logic: ICVR {self.icvr_overall}, HCS {self.hcs_overall}, MDI {self.mdi_mean}, density gap {self.dsi_gap}"


class LogicEvaluator:
    def __init__(self, real_df: DataFrame, schema: DataSchema, spec: LogicSpec, random_state: int = 42):
        self.real, self.schema, self.spec, self.seed = real_df, schema, spec, random_state
        for det, dep in spec.known_fds:
            if {det, dep} <= set(real_df.columns):
                soft = fd_softness(real_df, det, dep).first()["softness"]
                if soft is not None and soft > spec.fd_violation_tolerance:
                    log.warning("%s -> %s holds for %.1f %% of the real determinants only", det, dep, 100 * (1 - soft))

    def evaluate(self, synth: DataFrame, density: bool = True) -> Dim2Result:
        from tabscore.operators.density import density_gap

        out, have = Dim2Result(), set(synth.columns) & set(self.real.columns)
        fds = [p for p in self.spec.known_fds if set(p) <= have]
        if fds:
            rates = {r["key"]: r["value"] for r in flag_rates(fd_flags(self.real, synth, fds), "fd", [f"{a}->{b}" for a, b in fds]).collect()}
            out.icvr_overall, out.icvr = rates.pop("overall"), rates
        chains = [c for c in self.spec.hierarchies if set(c) <= have]
        if chains:
            rates = {r["key"]: r["value"] for r in flag_rates(hierarchy_flags(self.real, synth, chains), "chain", ["->".join(c) for c in chains]).collect()}
            out.hcs_overall, out.hcs = rates.pop("overall"), rates
        equations = [e for e in self.spec.math_equations if {e[0], e[2], e[3]} <= have and e[1] in OPERATORS]
        if equations:
            out.mdi = {r["key"]: r["value"] for r in mdi_per_equation(synth, equations).collect()}
            known = [v for v in out.mdi.values() if v is not None]
            out.mdi_mean = sum(known) / len(known) if known else None
        if self.spec.constraints:
            rates = {r["key"]: r["value"] for r in constraint_rates(self.real, synth, self.spec.constraints).collect()}
            out.constraints_overall, out.constraints = rates.pop("overall"), rates
        if density and self.schema.continuous_columns:
            out.real_ll, out.synth_ll, out.dsi_gap = density_gap(self.real, synth, self.schema.continuous_columns, self.seed)
        return out
