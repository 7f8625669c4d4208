"""Mode-specific normalisation and mixed columns (E17-E19), the encoder chain (E24, E25) and its blocks.

A column's modes (mean, deviation, weight; at most ten) are fitted by sums over
the column; encoding and decoding are column expressions over these few numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidspark.functions import hash_uniform
from fidspark.functions.numeric import digamma
from fidspark.operators import encode
from fidspark.spec import TableSpec

CLIP = 0.99  # encoded values stay within +-CLIP
SPREAD = 4.0  # deviations of a mode that the unit range spans


@dataclass(frozen=True)
class Modes:
    """Modes of one column in order of frequency (most frequent first), and its listed special values."""

    mean: tuple[float, ...]
    std: tuple[float, ...]
    weight: tuple[float, ...]
    special: tuple[float, ...] = ()

    @property
    def width(self) -> int:
        return len(self.special) + len(self.mean)


def _log_shares(x: Column, modes: Modes) -> list[Column]:
    """Log of weight times density per mode, up to a constant."""
    return [F.lit(float(np.log(w))) - F.lit(float(np.log(s))) - F.pow((x - F.lit(m)) / F.lit(s), 2) / 2
            for m, s, w in zip(modes.mean, modes.std, modes.weight)]


CONCENTRATION, ITERATIONS, TOLERANCE = 0.001, 100, 1e-3


def fit_modes(df: DataFrame, col: str, components: int = 10, min_weight: float = 0.005, special: Sequence[float] = (),
              concentration: float = CONCENTRATION, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Modes:
    """E17/E19 fit: a Gaussian mixture of the column without nulls and ``special`` values, its weights by stick-breaking.

    Variational EM under a Dirichlet-process prior of ``concentration``, which
    empties components that the data do not need: each round is one aggregate
    of three sums per component over the distinct values, and the driver holds
    a few numbers per component. It starts from equal shares of the values in
    order and ends when no responsibility total moves by ``tolerance`` of the
    rows, or after ``iterations`` rounds. Modes of a weight up to
    ``min_weight`` and modes that are no row's likeliest are dropped; a column
    of one value, or of none, has one mode.
    """
    x = F.col(col).cast("double")
    rows = df.select(x.alias("_x")).where("_x IS NOT NULL")
    if special:
        rows = rows.where(~F.col("_x").isin(*[float(v) for v in special]))
    cuts = [F.percentile_approx("_x", [i / components for i in range(1, components)], 10_000).alias("cuts")] if components > 1 else []
    st = rows.agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"), F.count("*").alias("n"), *cuts).first()
    if not st["s"]:
        return Modes((float(st["m"] or 0.0),), (1.0,), (1.0,), tuple(special))
    # fitted on the standardised column: variances of tiny or huge units are then as well conditioned
    unit = (rows.groupBy("_x").agg(F.count("*").alias("n"))
            .select(((F.col("_x") - F.lit(st["m"])) / F.lit(st["s"])).alias("u"), F.col("n").cast("double").alias("n"))).persist()
    edges = [(v - st["m"]) / st["s"] for v in (st["cuts"] if components > 1 else [])]
    shares = F.array(*[((F.col("u") > lo) & (F.col("u") <= hi)).cast("double") for lo, hi in zip([-np.inf, *edges], [*edges, np.inf])])
    sums = _mode_sums(unit, shares, components)
    for _ in range(iterations):
        post = _posterior(*sums, concentration)
        before = sums[0]
        sums = _mode_sums(unit, _responsibilities(post), components)
        if np.abs(sums[0] - before).max() < tolerance * st["n"]:
            break
    unit.unpersist()
    post = _posterior(*sums, concentration)
    found = [(float(m * st["s"] + st["m"]), float(max(np.sqrt(v), 1e-6) * st["s"]), float(w))
             for m, v, w in zip(post["mean"], post["variance"], post["weight"]) if w > min_weight]
    modes = Modes(*map(tuple, zip(*found)), tuple(special))
    likeliest = rows.groupBy(_first_max(_log_shares(F.col("_x"), modes)).alias("i")).agg(F.count("*").alias("n")).collect()
    kept = [found[r["i"]] for r in sorted(likeliest, key=lambda r: (-r["n"], r["i"]))]
    return Modes(*map(tuple, zip(*kept)), tuple(special))


def _mode_sums(unit: DataFrame, shares: Column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per component the sums of responsibility, of it times u and times u squared."""
    r = unit.select("u", "n", shares.alias("r"))
    row = r.agg(*[F.sum(F.get("r", F.lit(i)) * F.col("n") * F.pow("u", F.lit(p))).alias(f"s{p}_{i}") for p in range(3) for i in range(k)]).first()
    return tuple(np.array([row[f"s{p}_{i}"] for i in range(k)]) for p in range(3))


def _posterior(n: np.ndarray, s: np.ndarray, q: np.ndarray, concentration: float) -> dict[str, np.ndarray]:
    """Means, variances, weights and what the expected log shares are made of; the prior is one row of a standard normal."""
    held = n + 1e-12
    mean, spread = s / held, np.maximum(q / held - (s / held) ** 2, 0.0) + 1e-6
    beta, dof = 1 + n, 1 + n
    centre = n * mean / beta
    variance = (1 + n * spread + n / beta * mean**2) / dof
    a, b = 1 + n, concentration + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)
    log_stick, log_rest = digamma(a) - digamma(a + b), digamma(b) - digamma(a + b)
    weight = a / (a + b) * np.append(1.0, np.cumprod(b / (a + b))[:-1])
    log_weight = log_stick + np.append(0.0, np.cumsum(log_rest)[:-1])
    constant = log_weight - 0.5 * np.log(variance) + 0.5 * (digamma(dof / 2) - np.log(dof / 2)) - 0.5 / beta
    return {"mean": centre, "variance": variance, "weight": weight / weight.sum(), "constant": constant}


def _responsibilities(post: dict[str, np.ndarray]) -> Column:
    """Shares of a row's components, as an array."""
    # constant arrays, so that the generated code is the same in every round
    part = F.arrays_zip(*[F.array(*[F.lit(float(v)) for v in post[name]]).alias(name) for name in ("constant", "mean", "variance")])
    logs = F.transform(part, lambda x: x["constant"] - (F.col("u") - x["mean"]) * (F.col("u") - x["mean"]) / (2 * x["variance"]))
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return once(logs, lambda x: once(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: once(
        F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(e, lambda v: v / total))))


def _first_max(values: Sequence[Column]) -> Column:
    """0-based place of the largest value, the first of equals."""
    arr = F.array(*values)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def encode_modes(df: DataFrame, col: str, modes: Modes, key: str | None = None, seed: int = 0) -> DataFrame:
    """Add <col>_u (the value within its mode, clipped) and <col>_mode (its slot).

    Slots are the special values, then the modes. With ``key`` the mode is drawn
    by responsibility, else it is the likeliest. A special value has its own
    slot and, as value, its distance to the nearest mode in that mode's
    units. A null has neither.
    """
    x = F.col(col).cast("double")
    logs = _log_shares(x, modes)
    if key is None:
        mode = _first_max(logs)
    else:
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        shares = [F.exp(v - top) for v in logs]
        total = sum(shares[1:], shares[0])
        target, running, mode = hash_uniform(key, seed) * total, shares[0], F.lit(len(logs) - 1)
        bounds = [running]
        for s in shares[1:-1]:
            running = running + s
            bounds.append(running)
        for i in reversed(range(len(logs) - 1)):
            mode = F.when(target < bounds[i], F.lit(i)).otherwise(mode)
    means, stds = (F.array(*[F.lit(v) for v in part]) for part in (modes.mean, modes.std))
    within = (x - F.get(means, F.col("_m"))) / (SPREAD * F.get(stds, F.col("_m")))
    u, slot = F.greatest(F.least(within, F.lit(CLIP)), F.lit(-CLIP)), F.col("_m") + len(modes.special)
    for i, v in enumerate(modes.special):
        at = int(np.argmin([abs(v - m) for m in modes.mean]))
        u = F.when(x == float(v), F.lit(abs(v - modes.mean[at]) / (SPREAD * modes.std[at]))).otherwise(u)
        slot = F.when(x == float(v), F.lit(i)).otherwise(slot)
    return df.withColumn("_m", mode).withColumn(f"{col}_u", F.when(x.isNotNull(), u)).withColumn(
        f"{col}_mode", F.when(x.isNotNull(), slot).cast("int")).drop("_m")


def decode_modes(df: DataFrame, col: str, modes: Modes, whole: bool = False) -> DataFrame:
    """E18/E19 inverse: <col>_u and <col>_mode back to ``col``; ``whole`` rounds (half to even) to whole numbers."""
    at, m = F.col(f"{col}_mode"), F.col(f"{col}_mode") - len(modes.special)
    means, stds = (F.array(*[F.lit(v) for v in part]) for part in (modes.mean, modes.std))
    x = F.col(f"{col}_u") * SPREAD * F.get(stds, m) + F.get(means, m)
    if modes.special:
        x = F.when(at < len(modes.special), F.get(F.array(*[F.lit(float(v)) for v in modes.special]), at)).otherwise(x)
    return df.withColumn(col, F.bround(x) if whole else x).drop(f"{col}_u", f"{col}_mode")


@dataclass
class Encoder:
    """Numeric nulls -> dequantise -> normalise -> categorical nulls -> rare -> ordinal, fitted on train.

    ``transform`` gives (keys, num array, cat array of indices): null numbers
    take the train mean, unknown categories the index after the last. The
    target stays a column of its own unless ``concat_target`` (E25): it then
    comes first in the categorical block, or in the numeric one for regression.
    """

    spec: TableSpec
    key: str
    scale: str = "standard"  # or "minmax"
    dequantise: Sequence[str] = ()
    min_frequency: float = 0.0
    concat_target: bool = False
    seed: int = 0
    state: dict = field(default_factory=dict)

    def _blocks(self) -> tuple[list[str], list[str]]:
        num, cat = list(self.spec.num), list(self.spec.cat)
        if self.concat_target and self.spec.target:
            (num if self.spec.task == "regression" else cat).insert(0, self.spec.target)
        return num, cat

    def fit(self, train: DataFrame) -> "Encoder":
        num, cat = self._blocks()
        means = train.agg(*[F.avg(c).alias(c) for c in num]).first().asDict() if num else {}
        filled = train.fillna({c: m for c, m in means.items() if m is not None})
        noisy = encode.dequantize(filled, self.dequantise, self.key, seed=self.seed)
        self.state = {"means": means, "scale": encode.fit_scale(noisy, num) if num else {}}
        if cat:
            common = encode.fit_dictionary(train, cat, order="freq").where("idx = 0").collect()  # one row per column
            self.state["modes"] = {r["feature"]: r["value"] for r in common}
            self.state["train"] = self._cats(train, cat)
            collapsed = self._rare(self.state["train"], cat)
            self.state["dictionary"] = encode.fit_dictionary(collapsed, cat)
        return self

    def _cats(self, df: DataFrame, cat: Sequence[str]) -> DataFrame:
        modes = self.state["modes"]
        return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c))).alias(c) if c in cat else F.col(c) for c in df.columns])

    def _rare(self, df: DataFrame, cat: Sequence[str]) -> DataFrame:
        return encode.collapse_rare(df, cat, self.min_frequency, self.state["train"]) if self.min_frequency else df

    def transform(self, df: DataFrame) -> DataFrame:
        num, cat = self._blocks()
        out = df.fillna({c: m for c, m in self.state["means"].items() if m is not None})
        out = encode.dequantize(out, self.dequantise, self.key, seed=self.seed)
        scaled = encode.standard_scale if self.scale == "standard" else encode.minmax_scale
        out = scaled(out, self.state["scale"])
        if cat:
            out = encode.ordinal(self._rare(self._cats(out, cat), cat), cat, self.state["dictionary"])
        kept = [self.key] + ([self.spec.target] if self.spec.target and not self.concat_target else [])
        return out.select(*kept, F.array(*[F.col(c).cast("double") for c in num]).cast("array<double>").alias("num"),
                          F.array(*[F.col(c) for c in cat]).cast("array<int>").alias("cat"))

    def split(self, encoded: DataFrame) -> DataFrame:
        """The blocks back to one column per feature (and target), still encoded."""
        num, cat = self._blocks()
        kept = [c for c in encoded.columns if c not in ("num", "cat")]
        return encoded.select(*kept, *[F.get("num", F.lit(i)).alias(c) for i, c in enumerate(num)],
                              *[F.get("cat", F.lit(i)).alias(c) for i, c in enumerate(cat)])

    def inverse(self, encoded: DataFrame) -> DataFrame:
        """Encoded blocks back to values; an index after the last category gives null."""
        num, cat = self._blocks()
        scaled = encode.standard_scale if self.scale == "standard" else encode.minmax_scale
        out = scaled(self.split(encoded), self.state["scale"], inverse=True)
        out = out.select(*[encode.dequantize_inverse(c).alias(c) if c in self.dequantise else F.col(c) for c in out.columns])
        return encode.ordinal_inverse(out, cat, self.state["dictionary"]) if cat else out
