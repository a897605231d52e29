"""Exact most-similar rows by cosine, without comparing or emitting all pairs.

Input is long form (key, feature, weight) with vectors no longer than one, so the
similarity of two keys is the dot product.

1. Keys with equal vectors are one *profile*.  A profile keeps its k+1 smallest
   keys: no other member can be among the k nearest of anybody, ties going to the
   smaller key.  A group of copies of any size so becomes one row.
2. Profiles sorted by their rarest features are compared with their neighbours in
   that order.  The result is a lower bound on the (k+1)-th best similarity.
3. A profile at least that similar must share one of the rarest features of the
   probing profile: the features beyond its *prefix* are too light to reach the
   bound.  Only postings of prefix features are looked at.
4. Postings of a frequent feature are cut into spans of bounded size; a task
   holds one span of probes and one span of postings, multiplies the rows that
   share a prefix feature chunk by chunk, keeps what reaches the bound and returns
   the k+1 best per probe.  Spans grow with the table, so a row
   is sent to about ``PARTS`` spans until these reach their bound.

Nothing is capped: bounds only leave out pairs that cannot be in the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.operators.topk import best_per_group
from martlet.session import cut_lineage

DIGITS = 6  # similarities equal to this many digits are ties
#: Spans that the postings of a feature held by all profiles are cut into; chunks in a span at most.
PARTS, MOST_CHUNKS = 8, 32
_SLACK = 1e-5


def _dense(ids, weights, columns: np.ndarray) -> np.ndarray:
    """Rows of (ids, weights) lists as a matrix over the given feature ids."""
    out = np.zeros((len(ids), len(columns)))
    if out.size:
        flat, w = (np.concatenate([np.asarray(x) for x in lists]) for lists in (ids, weights))
        row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        spots = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        known = columns[spots] == flat
        out[row[known], spots[known]] = w[known]
    return out


def _profiles(long: DataFrame, key: str, feature: str, weight: str, k: int):
    """(members, profiles, features): copies folded, features numbered rarest first."""
    sizes = long.groupBy(feature).agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are features: capped vocabulary plus one-hot columns
    numbered = sizes.select(feature, (F.row_number().over(Window.orderBy("n", feature)) - 1).alias("fid"))
    packed = (long.join(numbered, feature).groupBy(key)
              .agg(F.array_sort(F.collect_list(F.struct("fid", F.col(weight).alias("w")))).alias("v")))
    # the vector itself, hashed twice, names the profile
    keyed = cut_lineage(packed.select(
        key, "v", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(7), "v")).alias("pid")))
    members = best_per_group(keyed.select("pid", key, "v"), ["pid"], [F.asc(key)], k + 1, "nth")
    members = cut_lineage(members)
    profiles = members.where("nth = 1").select(
        "pid", F.col(key).alias("first_key"), F.col("v.fid").alias("ids"), F.col("v.w").alias("weights"))
    return keyed.select(key, "pid"), members.select("pid", key, "nth"), profiles


def _bounds(profiles: DataFrame, k: int, chunk: int) -> DataFrame:
    """Add ``prefix``: how many of the rarest features must be probed, and ``least``: what a neighbour must reach."""
    schema = "pid string, first_key string, ids array<int>, weights array<double>, prefix int, least double"
    first_type = profiles.schema["first_key"].dataType.simpleString()
    schema = schema.replace("first_key string", f"first_key {first_type}")

    def bound(batches):
        for batch in batches:
            for start in range(0, len(batch), chunk):
                part = batch.iloc[start:start + chunk]
                columns = np.unique(np.concatenate([np.asarray(i) for i in part["ids"]]))
                m = _dense(part["ids"], part["weights"], columns)
                sims = m @ m.T
                np.fill_diagonal(sims, -1.0)
                need = min(k + 1, len(part))
                best = np.partition(sims, len(part) - need, axis=1)[:, len(part) - need]
                reach = np.maximum(best, 0.0) if need == k + 1 else np.zeros(len(part))
                prefix = []
                for w, least in zip(part["weights"], reach):
                    w = np.asarray(w)
                    rest = np.sqrt(np.cumsum((w * w)[::-1])[::-1])  # length from here on
                    prefix.append(int((rest >= least - _SLACK).sum()))
                yield part.assign(prefix=prefix, least=reach - _SLACK)

    ordered = profiles.repartitionByRange("ids", "weights", "pid").sortWithinPartitions("ids", "weights", "pid")
    return ordered.mapInPandas(bound, schema)


def _blocks(probes: DataFrame, span: int):
    """Feature groups with the number of probe and posting spans of each."""
    uses = probes.select(F.posexplode("ids").alias("at", "fid"), "prefix").groupBy("fid").agg(
        F.count(F.lit(1)).alias("held"), F.count_if(F.col("at") < F.col("prefix")).alias("probed"))
    # one row per feature; small features share a group of about one span
    fill = F.sum(F.least("held", F.lit(span))).over(
        Window.orderBy("fid").rowsBetween(Window.unboundedPreceding, -1))
    grouped = uses.where("probed > 0").select(
        "fid", "held", "probed", F.floor(F.coalesce(fill, F.lit(0)) / span).alias("g"))
    per = Window.partitionBy("g")

    def parts(c):
        return F.ceil(F.sum(c).over(per) / span).cast("int")

    return grouped.select("fid", "g", parts("probed").alias("p_parts"), parts("held").alias("d_parts"))


def _sides(probes: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Probes and postings, each row once for every span of the other side."""
    span = min(max(chunk, -(-probes.count() // PARTS)), MOST_CHUNKS * chunk)
    blocks = cut_lineage(_blocks(probes, span))

    def side(prefix_only: bool):
        at = probes.select("pid", "prefix", F.posexplode("ids").alias("at", "fid"))
        if prefix_only:
            at = at.where(F.col("at") < F.col("prefix"))
        return (at.select("pid", "fid").join(blocks, "fid")
                .select("pid", "g", "p_parts", "d_parts").distinct()
                .join(probes, "pid"))

    def spread(df, mine: str, other: str, mine_parts: str, other_parts: str):
        own = F.pmod(F.xxhash64("pid"), F.col(mine_parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1))
        # fresh aliases: both sides come from the same table
        return df.select(*[F.col(c).alias(f"{mine}_{c}") for c in ("g", *probes.columns)],
                         own.alias(f"{mine}_{mine}"), every.alias(f"{mine}_{other}"))

    return (spread(side(True), "pc", "dc", "p_parts", "d_parts"),
            spread(side(False), "dc", "pc", "d_parts", "p_parts"))


def _best_spots(row, spot, sim, most: int):
    """The ``most`` best (row, spot, similarity) of each row; of equals, the first spot."""
    order = np.lexsort((spot, -sim, row))
    row, spot, sim = row[order], spot[order], sim[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < most], spot[nth < most], sim[nth < most]


def _score(k: int, chunk: int):
    def nearest(left: pd.DataFrame, right: pd.DataFrame, flat: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        """The k+1 best of ``right`` for each of a chunk of probes; of equals, the first.

        Only rows with a feature that some probe must look at are multiplied, and only
        similarities that reach what a probe has found before are kept.
        """
        columns = np.unique(np.concatenate([np.asarray(i) for i in left["ids"]]))
        probed = np.unique(np.concatenate([np.asarray(i)[:n] for i, n in zip(left["ids"], left["prefix"])]))
        looked = np.zeros(max(flat.max(), probed.max()) + 1, bool)
        looked[probed] = True
        met = np.flatnonzero(np.logical_or.reduceat(looked[flat], starts))
        m, a, b = _dense(left["ids"], left["weights"], columns), left["pid"].to_numpy(), right["pid"].to_numpy()
        least, most = left["least"].to_numpy(float).copy(), k + 1
        ids, weights = right["ids"].to_numpy(), right["weights"].to_numpy()
        row, spot, sim = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for start in range(0, len(met), chunk):
            part = met[start:start + chunk]
            sims = m @ _dense(ids[part], weights[part], columns).T
            r, c = np.nonzero(sims >= least[:, None])
            found = np.round(sims[r, c], DIGITS)
            c = part[c]
            new = np.flatnonzero((found > 0) & (a[r] != b[c]))
            row, spot, sim = np.concatenate([row, r[new]]), np.concatenate([spot, c[new]]), np.concatenate([sim, found[new]])
            if len(row) > 4 * most * len(a):
                row, spot, sim = _best_spots(row, spot, sim, most)
                full = np.flatnonzero(np.bincount(row, minlength=len(a)) == most)
                last = np.searchsorted(row, full, "right") - 1
                least[full] = np.maximum(least[full], sim[last] - _SLACK)
        row, spot, sim = _best_spots(row, spot, sim, most)
        return pd.DataFrame({"pid_a": a[row], "pid_b": b[spot], "sim": sim})

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"pid_a": [], "pid_b": [], "sim": []})
        left, right = left.rename(columns=lambda c: c[3:]), right.rename(columns=lambda c: c[3:])
        # probes with like features stand together, so that a chunk has few columns
        left = left.iloc[sorted(range(len(left)), key=list(map(tuple, left["ids"])).__getitem__)]
        right = right.sort_values("first_key", kind="stable")
        flat = np.concatenate([np.asarray(i) for i in right["ids"]])
        starts = np.concatenate([[0], np.cumsum([len(i) for i in right["ids"]])[:-1]])
        return pd.concat([nearest(left.iloc[s:s + chunk], right, flat, starts) for s in range(0, len(left), chunk)])
    return best


def most_similar(long: DataFrame, key: str, k: int = 10, feature: str = "feature",
                 weight: str = "weight", chunk: int = 1024) -> DataFrame:
    """(key, neighbour, similarity, rank): the ``k`` nearest other keys of each key.

    Only neighbours with something in common are listed.
    """
    keys, members, profiles = _profiles(long, key, feature, weight, k)
    probes = cut_lineage(_bounds(profiles, k, chunk))
    left, right = _sides(probes, chunk)
    scored = (left.groupBy("pc_g", "pc_pc", "pc_dc")
              .cogroup(right.groupBy("dc_g", "dc_pc", "dc_dc"))
              .applyInPandas(_score(k, chunk), "pid_a string, pid_b string, sim double"))
    pairs = scored.groupBy("pid_a", "pid_b").agg(F.max("sim").alias("sim"))
    own = profiles.select(
        F.col("pid").alias("pid_a"), F.col("pid").alias("pid_b"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w), DIGITS).alias("sim"))
    # back from profiles to keys: k+1 members at most stand for each profile
    listed = pairs.union(own).join(members.select(
        F.col("pid").alias("pid_b"), F.col(key).alias("neighbour")), "pid_b")
    best = best_per_group(listed, ["pid_a"], [F.desc("sim"), F.asc("neighbour")], k + 1)
    lists = best.groupBy(F.col("pid_a").alias("pid")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour", "sim"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col(key)), 1, k)
    return (keys.join(lists, "pid").select(key, F.posexplode(others).alias("at", "x"))
            .select(key, F.col("x.neighbour").alias("neighbour"), F.col("x.sim").alias("similarity"),
                    (F.col("at") + 1).alias("rank")))
