"""Skeletons as arrays: frames of joints, each joint an array of numbers (x, y, score or x, y, z). Expressions, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayweave.functions.arrays import let

LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_HIP, RIGHT_HIP = 5, 6, 11, 12
#: Left and right partners of the seventeen joints.
MIRROR = (0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15)


def visible(joints: Column, least: float = 0.3) -> Column:
    """Number of joints with a score of at least `least`."""
    return F.size(F.filter(joints, lambda j: F.get(j, 2) >= least))


def usable(joints: Column, least_joints: int = 8, least: float = 0.3) -> Column:
    return F.coalesce(visible(joints, least) >= least_joints, F.lit(False))


def box_of(joints: Column, pad: float = 0.12, least: float = 0.3) -> Column:
    """Box around the visible joints, padded by a share of its sides; null with fewer than two joints or less than two pixels."""
    seen = F.filter(joints, lambda j: F.get(j, 2) >= least)
    side = lambda v, i: F.transform(v, lambda j: F.get(j, i))
    ends = let(seen, lambda v: F.struct(F.size(v).alias("n"), F.array_min(side(v, 0)).alias("x"), F.array_max(side(v, 0)).alias("xm"), F.array_min(side(v, 1)).alias("y"), F.array_max(side(v, 1)).alias("ym")))

    def padded(b: Column) -> Column:
        w, h = b["xm"] - b["x"], b["ym"] - b["y"]
        box = F.struct((b["x"] - pad * w).alias("x1"), (b["y"] - pad * h).alias("y1"), (b["xm"] + pad * w).alias("x2"), (b["ym"] + pad * h).alias("y2"))
        return F.when((b["n"] >= 2) & (w >= 2) & (h >= 2), box)

    return let(ends, padded)


def _middle(joints: Column, a: int, b: int, i: int) -> Column:
    return (F.get(F.get(joints, a), i) + F.get(F.get(joints, b), i)) / 2


def torso(joints: Column) -> Column:
    """Distance between the middles of the shoulders and of the hips."""
    d = lambda i: _middle(joints, LEFT_SHOULDER, RIGHT_SHOULDER, i) - _middle(joints, LEFT_HIP, RIGHT_HIP, i)
    return F.hypot(d(0), d(1))


def torso_vertical_ratio(joints: Column, least: float = 0.3) -> Column:
    """Vertical share of the torso's length; null if one of its four joints is weak or the torso has no length."""
    weak = [F.get(F.get(joints, k), 2) < least for k in (LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_HIP, RIGHT_HIP)]
    rise = F.abs(_middle(joints, LEFT_SHOULDER, RIGHT_SHOULDER, 1) - _middle(joints, LEFT_HIP, RIGHT_HIP, 1))
    return F.when(~(weak[0] | weak[1] | weak[2] | weak[3]) & (torso(joints) >= 1e-6), rise / torso(joints))


def normalised(frames: Column) -> Column:
    """Frames (array of arrays of [x, y, score]) with the hips of the first seen frame as origin and the mean torso of seen frames as
    unit (1 if it is no more than 0.001); unseen joints are exactly zero. A window without any seen joint stays as it is."""
    found = F.filter(frames, lambda f: F.exists(f, lambda j: F.get(j, 2) > 0))

    def moved(seen: Column) -> Column:
        mean = F.aggregate(seen, F.lit(0.0), lambda a, f: a + torso(f)) / F.greatest(F.size(seen), F.lit(1))
        start = F.get(seen, 0)
        ref = F.struct(mean.alias("m"), _middle(start, LEFT_HIP, RIGHT_HIP, 0).alias("x"), _middle(start, LEFT_HIP, RIGHT_HIP, 1).alias("y"))
        scale = lambda r: F.when(r["m"] > 1e-3, r["m"]).otherwise(1.0)
        zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        joint = lambda r: lambda j: F.when(F.get(j, 2) > 0, F.array((F.get(j, 0) - r["x"]) / scale(r), (F.get(j, 1) - r["y"]) / scale(r), F.get(j, 2))).otherwise(zero)
        return let(ref, lambda r: F.transform(frames, lambda f: F.transform(f, joint(r))))

    return let(found, lambda seen: F.when(F.size(seen) == 0, frames).otherwise(moved(seen)))


def resampled(frames: Column, n: int) -> Column:
    """n frames by linear interpolation at even places from the first to the last."""

    def of(v: Column) -> Column:
        last = F.size(v) - 1

        def at(k: Column) -> Column:
            place = k * last / max(1, n - 1)
            lo = F.floor(place).cast("int")
            w = place - lo
            return F.zip_with(F.get(v, lo), F.get(v, F.least(lo + 1, last)), lambda a, b: F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    return let(frames, of)


def bridged(frames: Column, present: Column) -> Column:
    """frames with absent ones interpolated between the nearest present ones, held at the ends; unchanged if none is present."""

    def between(f: Column, i: Column, lo: Column, hi: Column) -> Column:
        w = (i - lo) / (hi - lo)
        mixed = F.zip_with(F.get(f, lo), F.get(f, hi), lambda p, q: F.zip_with(p, q, lambda x, y: (1 - w) * x + w * y))
        return F.when(i == lo, F.get(f, lo)).otherwise(mixed)

    def filled(f: Column, seen: Column) -> Column:
        """Stretch by stretch from one present frame to the next, so in time linear in the frames."""
        first, last, n = F.get(seen, 0), F.get(seen, F.size(seen) - 1), F.size(seen)
        stretch = lambda lo, hi: F.transform(F.sequence(lo, hi - 1), lambda i: between(f, i, lo, hi))
        inner = F.flatten(F.transform(F.slice(seen, 1, n - 1), lambda lo, j: stretch(lo, F.get(seen, j + 1))))
        return F.concat(F.array_repeat(F.get(f, first), first), inner, F.array_repeat(F.get(f, last), F.size(f) - last))

    seen = F.filter(F.sequence(F.lit(0), F.size(frames) - 1), lambda i: F.get(present, i))
    return let(frames, lambda f: let(seen, lambda s: F.when(F.size(s) == 0, f).otherwise(filled(f, s))))


def bones(frames: Column, parents: list[int]) -> Column:
    """Each joint less its parent; a joint that is its own parent becomes zero."""
    up = F.array(*[F.lit(p) for p in parents])  # a constant, folded once
    return F.transform(frames, lambda f: F.transform(f, lambda j, k: F.zip_with(j, F.get(f, F.get(up, k)), lambda x, y: x - y)))


def centred(frames: Column, root: int) -> Column:
    """Each frame less its root joint; not for falls, whose motion it removes."""
    return F.transform(frames, lambda f: F.transform(f, lambda j: F.zip_with(j, F.get(f, root), lambda x, y: x - y)))


def motion(frames: Column) -> Column:
    """Step to the next frame; zero for the last."""
    return let(frames, lambda v: F.transform(v, lambda f, t: F.zip_with(f, F.get(v, F.least(t + 1, F.size(v) - 1)), lambda j, k: F.zip_with(j, k, lambda x, y: y - x))))


def mirrored(frames: Column, partner: tuple[int, ...] = MIRROR) -> Column:
    """Left and right exchanged and x negated."""
    order = F.array(*[F.lit(p) for p in partner])
    return F.transform(frames, lambda f: F.transform(order, lambda p: F.transform(F.get(f, p), lambda x, i: F.when(i == 0, -x).otherwise(x))))


def flattened(frames: Column) -> Column:
    return F.flatten(F.flatten(frames))


def second_person(other: Column, least_joints: int = 3, least_frames: int = 5) -> Column:
    """Whether the second slot's frames show a person: enough joints above 0.05 in enough frames."""
    return F.size(F.filter(other, lambda f: F.size(F.filter(f, lambda j: F.get(j, 2) > 0.05)) >= least_joints)) >= least_frames


def clip_windows(frames: Column, length: int = 30, stride: int = 15, least_joints: int = 8) -> Column:
    """struct of start and frames for every window of which half the frames show at least least_joints joints above 0.3."""
    starts = F.when(F.size(frames) >= length, F.sequence(F.lit(0), F.size(frames) - length, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(frames, s + 1, length).alias("frames")))
    good = lambda f: F.size(F.filter(f, lambda j: F.get(j, 2) > 0.3)) >= least_joints
    return F.filter(cut, lambda w: F.size(F.filter(w["frames"], good)) * 2 >= length)


def with_midpoints(frames: Column, pairs: tuple[tuple[int, int], ...], n_joints: int) -> Column:
    """frames of n_joints joints, to each of which the midpoints of the pairs are appended (neck and pelvis, in the order of the graph that
    reads them); any other number of joints fails the job, as midpoints of derived joints would be of the wrong ones."""

    def frame(f: Column) -> Column:
        mid = [F.zip_with(F.get(f, a), F.get(f, b), lambda x, y: (x + y) / 2) for a, b in pairs]
        wrong = F.raise_error(F.concat(F.lit(f"expected {n_joints} joints, got "), F.size(f).cast("string"))).cast("array<array<double>>")
        return F.when(F.size(f) != n_joints, wrong).otherwise(F.concat(f, F.array(*mid)))

    return F.transform(frames, frame)


#: The four inputs of an ensemble, all derived from the joints.
STREAMS = ("joint", "bone", "joint_motion", "bone_motion")


def stream(frames: Column, name: str, parents: list[int]) -> Column:
    """One of STREAMS; ValueError for another name."""
    if name not in STREAMS:
        raise ValueError(f"unknown stream {name!r}; one of {STREAMS}")
    base = bones(frames, parents) if name.startswith("bone") else frames
    return motion(base) if name.endswith("motion") else base


def channels_first(persons: Column, n_channels: int = 3) -> Column:
    """Frames of persons of joints of channels to channels of frames of joints of persons: the order that models read. Exchanging persons
    and joints would give an array of the same size and be nonsense, so the order is spelled out here alone."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), lambda c: F.transform(persons, lambda frame: F.transform(F.sequence(F.lit(0), F.size(F.get(frame, 0)) - 1), lambda v: F.transform(frame, lambda person: F.get(F.get(person, v), c)))))
