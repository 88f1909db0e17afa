"""Base calls and locus evidence of traces.

A trace is one row, and its channels never leave it: a worker reads them from Arrow's buffers, or decodes them from the trace's
file, into numpy, finds peaks, ranks and medians of all calls of some traces at once, and gives back one row a call. Wherever `traces`
are asked for, they are decoded ones or files (path, content); of files the channels never leave the worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.sources import abif
from lociflow.sources.shipping import ship_bounded

KEYS = ("input_name", "input_sha256")
#: Rows of runs or loci whose samples are gathered at a time.
BLOCK = 8_192
#: Calls and samples of the traces that are worked on together, about.
CALLS, SAMPLES = 8_192, 131_072
PEAK = pa.struct([("height", pa.int32()), ("position", pa.int32()), ("source", pa.string())])
CALL = "call_index int, ploc int, w_start int, w_end int, peaks array<struct<height:int,position:int,source:string>>, primary_pos int, primary_heights array<int>, qualifying array<string>, primary string, ambiguity string, vendor_agrees boolean"
RUN = "w_start int, w_end int, min_snr double, max_secondary_snr double, noisy boolean"
EVIDENCE = "call_index int, ploc int, w_start int, w_end int, ctx_call_start int, ctx_call_end int, ctx_sample_start int, ctx_sample_end int, event_position int, heights array<int>, baselines array<double>, noise_sigmas array<double>, corrected array<double>, snrs array<double>, profile array<double>"
WARNINGS = "ambiguous_calls long, vendor_disagreements long, calls_without_peak long, noisy_regions long"
NOISE_SCALE = 0.67448975 * 2**0.5
#: The letters of calls: a base for each channel, N, and the code of two bases by the sum of their channels' bits.
LETTERS = pa.array([*X.BASES, "N"])
UNKNOWN = len(X.BASES)
PAIR_CODES = {sum(1 << X.BASES.index(b) for b in bases): code for code, bases in X.IUPAC.items() if len(bases) == 2}
CODES = pa.array([PAIR_CODES.get(bits, "N") for bits in range(1 << len(X.BASES))])
#: Of two bases the code of their bits, of others the letter of their strongest channel, behind the codes.
AMBIGUITIES, LETTER_BYTES = pa.concat_arrays([CODES, LETTERS]), np.frombuffer("".join(LETTERS.to_pylist()).encode(), np.uint8)
SOURCES = pa.array(["ploc_fallback", "local_maximum"])


def _median(values: Column) -> Column:
    ordered = F.sort_array(values)
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.transform(F.array(ordered), middle)[0]


class Traces:
    """Some traces of two calls or more, one behind the other: channels (a row for each), locations among all samples, and for each
    call its trace and the bounds of that one's samples and calls."""

    def __init__(self, some: Sequence[tuple[Sequence[np.ndarray], np.ndarray, str | None]]) -> None:
        self.samples, self.calls = (np.append(0, np.cumsum(x)) for x in ([len(c[0]) for c, _, _ in some], [len(p) for _, p, _ in some]))
        self.channels = np.stack([np.concatenate([c[k] for c, _, _ in some]) for k in range(4)])
        self.of = np.repeat(np.arange(len(some)), np.diff(self.calls))
        self.low, self.high = self.samples[self.of], self.samples[self.of + 1]
        self.first, self.behind = self.calls[self.of], self.calls[self.of + 1]
        self.index = np.arange(len(self.of)) - self.first
        self.ploc = np.concatenate([p for _, p, _ in some]).astype(np.int64) + self.low
        self.vendor = [(v or "").encode("latin-1", "replace")[:n] for (_, _, v), n in zip(some, np.diff(self.calls).tolist(), strict=True)]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the half-open windows around the locations: halfway to the neighbours."""
        p, first, last = self.ploc, self.calls[:-1], self.calls[1:] - 1
        middle = (p[:-1] + p[1:]) // 2
        starts, ends = np.append(0, middle), np.append(middle, 0)
        starts[first] = np.maximum(p[first] - (p[first + 1] - p[first]) // 2, self.samples[:-1])
        ends[last] = np.minimum(p[last] + (p[last] - p[last - 1] + 1) // 2, self.samples[1:])
        return starts, ends


def is_maximum(before: np.ndarray, value: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Positive local maxima; of a plateau both ends."""
    return (value > 0) & (((before <= value) & (value > after)) | ((before < value) & (value >= after)))


def maxima(samples: np.ndarray) -> np.ndarray:
    """is_maximum() of all samples of each row but its first and last, by steps."""
    rises, falls = samples[:, 1:] > samples[:, :-1], samples[:, 1:] < samples[:, :-1]
    # not lower behind a rise, or not higher ahead of a fall
    return (samples[:, 1:-1] > 0) & ((rises[:, :-1] & ~rises[:, 1:]) | (falls[:, 1:] & ~falls[:, :-1]))


def peaks(traces: Traces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, heights, positions, found) of the four channels' highest local maximum in each window, the first of
    equals; the height at the location where a window has none. The last three have a row a channel, a column a call."""
    channels, ploc = traces.channels, traces.ploc
    n, calls = channels.shape[1], len(ploc)
    starts, ends = traces.windows()
    height, position, found = np.ascontiguousarray(channels[:, ploc]), np.tile(ploc, (4, 1)), np.zeros((4, calls), bool)
    if n > 2:
        channel, at = np.nonzero(maxima(channels))
        at += 1
        window = np.searchsorted(starts, at, side="right") - 1
        # within the window, and not the first or last of the trace
        inside = (window >= 0) & (at < ends[window]) & (at > traces.low[window]) & (at < traces.high[window] - 1)
        if not inside.all():
            channel, at, window = channel[inside], at[inside], window[inside]
        if len(at):
            which = channel * calls + window
            high = channels[channel, at]
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            if len(first) < len(which):
                # height above, place below: the greatest is the highest, then the first
                best = np.maximum.reduceat((high.astype(np.int64) << 32) + (n - at), first)
                which, high, at = which[first], best >> 32, n - (best & 0xFFFFFFFF)
            height.reshape(-1)[which], position.reshape(-1)[which], found.reshape(-1)[which] = high, at, True
    return starts, ends, height, position, found


def noise(channel: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Median, and scaled median deviation of the steps (1 at least), of each interval of two samples or more. `bounds` are those of
    the traces in the channel."""
    base, sigma = np.zeros(len(starts)), np.ones(len(starts))
    if not len(starts):
        return base, sigma
    # a value that more than half of an interval has is its median; so intervals on a flat base need no sort. Which value is tried
    # only decides how many do, so some samples of each trace tell it
    bounds = np.array([0, len(channel)]) if bounds is None else bounds
    some = [channel[a : b : max(1, (b - a) // 256)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    level = np.repeat(np.array([np.partition(x, len(x) // 2)[len(x) // 2] for x in some]), np.diff(bounds))
    flat, still = np.zeros(len(channel) + 1, np.int64), np.zeros(len(channel), np.int64)
    np.cumsum(channel == level, out=flat[1:])
    np.cumsum(channel[1:] == channel[:-1], out=still[1:])
    lengths = ends - starts
    told = (2 * (flat[ends] - flat[starts]) > lengths) & (2 * (still[ends - 1] - still[starts]) > lengths - 1)
    base[told] = level[starts[told]]
    if told.all():
        return base, sigma
    sigma[told] = 0.0
    for length in np.unique(lengths[~told]):
        rows = np.flatnonzero((lengths == length) & ~told)
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            samples = channel[starts[some][:, None] + np.arange(length)].astype(np.float64)
            steps = np.diff(samples, axis=1)
            base[some] = np.median(samples, axis=1)
            sigma[some] = np.median(np.abs(steps - np.median(steps, axis=1, keepdims=True)), axis=1) / NOISE_SCALE
    return base, np.maximum(sigma, 1.0)


def _lists(values: np.ndarray, kind: pa.DataType, none: np.ndarray | None = None) -> pa.ListArray:
    """A row of each row of a matrix; null where `none` says so."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1), kind), mask=None if none is None else pa.array(none))


def _called(traces: Traces, ratio: float, wanted: Sequence[str], known: tuple | None = None) -> list[pa.Array]:
    starts, ends, height, position, found = known or peaks(traces)
    channels, low, n = traces.channels, traces.low, len(traces.ploc)
    rows = np.arange(n)
    # the highest channel, the first of equals, and the next height
    top, second, first = height[0], np.full(n, np.iinfo(height.dtype).min, height.dtype), np.zeros(n, np.int64)
    for c in range(1, 4):
        higher = height[c] > top
        second = np.where(higher, top, np.maximum(second, height[c]))
        top, first = np.where(higher, height[c], top), np.where(higher, c, first)
    place = position[first, rows]
    there = channels[:, place]  # heights at the strongest peak
    clear = (top > 0) & (top != second)
    enough = ratio * top
    holds = (height > 0) & (height >= enough) & (there > 0) & (there >= enough) & clear
    k, bits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for c in range(4):
        k += holds[c]
        bits += holds[c].astype(np.int64) << c
    strongest = np.where((k >= 1) & (k <= 3), first, UNKNOWN)
    small = lambda x: pa.array(np.asarray(x).astype(np.int32, copy=False))

    def four() -> pa.Array:
        flat = pa.StructArray.from_arrays([small(height.T.reshape(-1)), small((position - low).T.reshape(-1)), SOURCES.take(pa.array(found.T.reshape(-1).astype(np.int8)))], fields=list(PEAK))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), flat)

    def ambiguity() -> pa.Array:
        return AMBIGUITIES.take(pa.array(np.where(k == 2, bits, len(CODES) + np.where(k == 1, first, UNKNOWN))))

    def qualifying() -> pa.Array:
        edges = np.append(0, np.cumsum(k))
        letters = np.empty(edges[-1], np.int64)
        letters[edges[:-1][k == 1]] = first[k == 1]
        many = np.flatnonzero(k > 1)  # in the order of their heights
        if len(many):
            rank = np.argsort(-height[:, many].T.astype(np.int64), axis=1, kind="stable")
            kept = np.take_along_axis(holds[:, many].T, rank, axis=1)
            letters[np.repeat(k > 1, k)] = rank[kept]
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), LETTERS.take(pa.array(letters)))

    def agrees() -> pa.Array:
        there = traces.index < np.array([len(v) for v in traces.vendor])[traces.of]
        said = np.zeros(n, np.uint8)
        said[there] = np.frombuffer(b"".join(traces.vendor), np.uint8)
        return pa.array(said == LETTER_BYTES[strongest], mask=~there)

    made = {
        "call_index": lambda: small(traces.index), "ploc": lambda: small(traces.ploc - low), "w_start": lambda: small(starts - low), "w_end": lambda: small(ends - low), "peaks": four,
        "primary_pos": lambda: pa.array((place - low).astype(np.int32), mask=~clear), "primary_heights": lambda: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), small(there.T.reshape(-1)), mask=pa.array(~clear)), "qualifying": qualifying,
        "primary": lambda: LETTERS.take(pa.array(strongest)), "ambiguity": ambiguity, "vendor_agrees": agrees,
    }
    return [made[x]() for x in wanted]


def _round_metric(x: np.ndarray) -> np.ndarray:
    """expressions.round_metric() of finite values."""
    scaled = np.abs(x * 1e6)
    whole = np.trunc(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), x) / 1e6


def _highest(heights: np.ndarray, base: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios (primary, secondary) of calls by the heights, bases and noise of their channels, a row for each: the primary is the
    highest above its base, of equals the one of the higher ratio, and the secondary the next."""
    one = two = None
    for h, b, s in zip(heights, base, sigma, strict=True):
        above = np.maximum(h - b, 0.0)
        new = above, above / s
        if one is None:
            one, two = new, (np.full_like(above, -1.0), np.full_like(above, -1.0))
            continue
        first, second = ((new[0] > x[0]) | ((new[0] == x[0]) & (new[1] > x[1])) for x in (one, two))
        two = tuple(np.where(first, a, np.where(second, c, b)) for a, b, c in zip(one, two, new, strict=True))
        one = tuple(np.where(first, c, a) for a, c in zip(one, new, strict=True))
    return one[1], two[1]


def _measured(traces: Traces, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bases, noise, middle, common): of intervals of the traces `of`, a row a channel; for each trace an interval in its middle, and
    which intervals have that one's measures."""
    both = [noise(c, starts, ends, traces.samples) for c in traces.channels]
    base, sigma = np.stack([x[0] for x in both]), np.stack([x[1] for x in both])
    n = np.bincount(of, minlength=len(traces.vendor))
    middle = np.minimum(np.cumsum(n) - n + n // 2, max(0, len(of) - 1))
    m = middle[of]
    return base, sigma, middle, ((base == base[:, m]) & (sigma == sigma[:, m])).all(axis=0)


def _runs(traces: Traces, size: int, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first call, lowest primary, highest secondary ratio) of each run of `size` calls of a trace."""
    starts, ends, height, _, _ = known or peaks(traces)
    first = np.flatnonzero(np.arange(len(traces.of)) + size <= traces.behind)
    if not len(first):
        return first, np.zeros(0), np.zeros(0)
    base, sigma, middle, common = _measured(traces, starts[first], ends[first + size - 1], traces.of[first])
    # runs of one measure share the ratios of their calls, the others have their own
    m = middle[traces.of]
    one, two = _highest(height, base[:, m], sigma[:, m])
    n = len(one) - size + 1
    lowest, highest = one[:n].copy(), two[:n].copy()
    for j in range(1, size):
        np.minimum(lowest, one[j : j + n], out=lowest)
        np.maximum(highest, two[j : j + n], out=highest)
    lowest, highest = lowest[first], highest[first]
    rows, step = np.flatnonzero(~common), max(1, 16 * BLOCK // size)
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        calls = np.lib.stride_tricks.sliding_window_view(height, size, axis=-1)[:, first[some]]
        one, two = _highest(calls, base[:, some, None], sigma[:, some, None])
        lowest[some], highest[some] = one.min(axis=-1), two.max(axis=-1)
    return first, _round_metric(lowest), _round_metric(highest)


def _evidence(traces: Traces, size: int, wanted: Sequence[str]) -> list[pa.Array]:
    channels, ploc, offset = traces.channels, traces.ploc, traces.low
    n, samples = len(ploc), channels.shape[1]
    starts, ends = traces.windows()
    calls = traces.behind - traces.first
    begin = np.maximum(np.minimum(np.maximum(traces.index - (size - 1) // 2, 0), calls - size), 0)
    end = np.minimum(begin + size, calls)
    first, last = traces.first + begin, traces.first + end - 1
    base, sigma, middle, same = _measured(traces, starts[first], ends[last], traces.of)
    lengths = np.diff(traces.samples)
    summed = sum((np.maximum(c - np.repeat(b, lengths), 0.0) for c, b in zip(channels, base[:, middle], strict=True)), np.zeros(samples))
    base, sigma = base.T, sigma.T
    event = np.zeros(n, np.int64)
    low, high = np.maximum(starts, offset + 1), np.minimum(ends, traces.high - 1)  # where maxima may be
    for at in range(0, n, BLOCK):
        some = slice(at, at + BLOCK)
        width = int(max(0, (high[some] - low[some]).max()))
        places = low[some][:, None] - 1 + np.arange(width + 2)
        within = np.minimum(places, samples - 1)
        total, own = summed[within], np.flatnonzero(~same[some])  # other bases have their own sums
        if len(own):
            total[own] = 0.0
            for k, c in enumerate(channels):
                total[own] += np.maximum(c[within[own]] - base[some, k][own, None], 0.0)
        inner = places[:, 1:-1]
        peak = is_maximum(total[:, :-2], total[:, 1:-1], total[:, 2:]) & (inner < high[some][:, None])
        away = np.where(peak, np.abs(inner - ploc[some][:, None]), np.iinfo(np.int64).max)
        nearest = away.min(axis=1, initial=np.iinfo(np.int64).max)
        strongest = np.where(peak & (away == nearest[:, None]), total[:, 1:-1], -1.0)
        chosen = strongest.argmax(axis=1) if width else np.zeros(len(nearest), np.int64)  # the first of equals
        has = peak.any(axis=1)
        event[some] = np.where(has, low[some] + chosen, ploc[some])
    heights = channels[:, event].T
    corrected = np.maximum(heights - base, 0.0)
    small = lambda x: pa.array(np.asarray(x).astype(np.int32))

    def profile() -> pa.Array:
        total = corrected[:, 0] + corrected[:, 1] + corrected[:, 2] + corrected[:, 3]
        there = total > 0
        values = corrected / np.where(there, total, 1.0)[:, None]
        return _lists(values, pa.float64(), ~there)

    made = {
        "call_index": lambda: small(traces.index), "ploc": lambda: small(ploc - offset), "w_start": lambda: small(starts - offset), "w_end": lambda: small(ends - offset), "ctx_call_start": lambda: small(begin), "ctx_call_end": lambda: small(end),
        "ctx_sample_start": lambda: small(starts[first] - offset), "ctx_sample_end": lambda: small(ends[last] - offset), "event_position": lambda: small(event - offset), "heights": lambda: _lists(heights.astype(np.int32), pa.int32()),
        "baselines": lambda: _lists(base, pa.float64()), "noise_sigmas": lambda: _lists(sigma, pa.float64()), "corrected": lambda: _lists(corrected, pa.float64()), "snrs": lambda: _lists(corrected / sigma, pa.float64()), "profile": profile,
    }
    return [made[x]() for x in wanted]


def _chosen(kind: str, columns: Sequence[str] | None) -> dict[str, str]:
    """Names and kinds of the columns of `kind` that are wanted."""
    named = dict(x.split(" ", 1) for x in kind.split(", "))
    return {n: t for n, t in named.items() if columns is None or n in columns}


def _opened(b: pa.RecordBatch, digest: bool) -> Iterator[tuple[int, Sequence[np.ndarray], np.ndarray, str | None, str | None]]:
    """(row, channels, locations, vendor's letters, digest) of the good traces of a batch of (content), decoded here."""
    for i, content in enumerate(b.column(0)):
        data = content.as_py() or b""
        try:
            channels, ploc, vendor, _ = abif.decode(data)
        except abif.TraceError:
            continue
        yield i, channels, ploc, vendor, hashlib.sha256(data).hexdigest() if digest else None


def _held(b: pa.RecordBatch) -> Iterator[tuple[int, Sequence[np.ndarray], np.ndarray, str | None, str | None]]:
    """The same of a batch of (channels, ploc, vendor_primary)."""
    for i in range(b.num_rows):
        yield i, b.column(0)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(4, -1), b.column(1)[i].values.to_numpy(zero_copy_only=False), b.column(2)[i].as_py(), None


def _each_trace(traces: DataFrame, least: int, kept: Sequence[str], kind: dict[str, str], work: Callable[[Traces], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """`work` on the good traces of `least` calls or more, some at a time: the trace and the columns of its rows, which stand beside
    the kept columns. Those should be short, as each row has them."""
    ship_bounded(traces.sparkSession)
    encoded = "channels" not in traces.columns
    if encoded:
        traces = traces.withColumnsRenamed({"path": "input_name"}).withColumn("input_sha256", F.lit(None).cast("string"))
        given = traces.select("content", *kept)
    else:
        # the vendor's letters stay with their trace: each call beside all of them would grow with the square of its length
        given = traces.where("error_class IS NULL").select("channels", "ploc", "vendor_primary", *kept)
    least, digest, width = max(2, least), "input_sha256" in kept, len(given.columns) - len(kept)
    kinds = {k: given.schema[k].dataType.simpleString() for k in kept} | kind
    names = list(kinds)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, same, calls, samples = [], [], 0, 0

        def worked() -> pa.RecordBatch:
            of, out = work(Traces(some))
            row = pa.array(of)
            beside = [pa.array([x[j] for x in same], schema.field(j).type).take(row) for j in range(len(kept))]
            return pa.RecordBatch.from_arrays([*beside, *out], names=names)

        for b in batches:
            schema = pa.schema([pa.field(k, pa.string() if encoded and k == "input_sha256" else b.schema.field(width + j).type) for j, k in enumerate(kept)])
            for i, channels, ploc, vendor, sha in _opened(b, digest) if encoded else _held(b):
                if len(ploc) < least:
                    continue
                some.append((channels, ploc, vendor))
                same.append([sha if encoded and k == "input_sha256" else b.column(width + j)[i].as_py() for j, k in enumerate(kept)])
                calls, samples = calls + len(ploc), samples + len(channels[0])
                if calls >= CALLS or samples >= SAMPLES:
                    yield worked()
                    some, same, calls, samples = [], [], 0, 0
        if some:
            yield worked()

    return given.mapInArrow(each, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))


def call_bases(traces: DataFrame, ratio: float = 0.33, keys: tuple[str, ...] = KEYS, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a call: window, four peaks, primary and ambiguity letters, qualifying channels, agreement with the vendor.

    Channels are ranked by height, then by their order. A tie at the top, or no height, gives N. A channel qualifies if its
    own peak and its height at the strongest peak's place both reach ratio * top. `columns` names those that are wanted
    beside the keys; all without it.
    """
    kind = _chosen(CALL, columns)
    return _each_trace(traces, 2, keys, kind, lambda t: (t.of, _called(t, ratio, list(kind))))


def call_windows(traces: DataFrame, size: int = 10, least_snr: float = 3.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every run of `size` calls: lowest primary and highest secondary ratio of height to noise; noisy below `least_snr`."""

    def runs(t: Traces) -> tuple[np.ndarray, list[pa.Array]]:
        first, lowest, highest = _runs(t, size)
        at = t.index[first].astype(np.int32)
        return t.of[first], [pa.array(x) for x in (at, at + np.int32(size), lowest, highest, lowest < least_snr)]

    return _each_trace(traces, size, keys, _chosen(RUN, None), runs)


def locus_evidence(traces: DataFrame, size: int = 10, keys: tuple[str, ...] = KEYS, columns: Sequence[str] | None = None) -> DataFrame:
    """Evidence of each locus, independent of its call: context of `size` loci, baseline and noise of each channel there, the
    event nearest to the location among maxima of the summed corrected heights (greater total, then lower sample on ties),
    heights, corrected amplitudes, ratios, and the profile (null without any amplitude). `columns` as in call_bases()."""
    kind = _chosen(EVIDENCE, columns)
    return _each_trace(traces, 2, keys, kind, lambda t: (t.of, _evidence(t, size, list(kind))))


def warning_counts(traces: DataFrame, keys: tuple[str, ...] = KEYS, ratio: float = 0.33, size: int = 10, least_snr: float = 3.0, least: int = 2) -> DataFrame:
    """One row a trace: ambiguous calls, calls that differ from the vendor's, calls without a peak, and noisy regions, which are
    `least` noisy runs of call_windows() or more one after the other. They are counted where the trace is."""

    def counts(t: Traces) -> tuple[np.ndarray, list[pa.Array]]:
        known = peaks(t)
        ambiguity, place, agrees = _called(t, ratio, ("ambiguity", "primary_pos", "vendor_agrees"), known)
        first, lowest, _ = _runs(t, size, known)
        noisy, of = lowest < least_snr, t.of[first]
        begins = noisy & ~np.append(False, noisy[:-1] & (of[1:] == of[:-1]))[: len(noisy)]
        lengths = np.bincount(np.cumsum(begins)[noisy] - 1, minlength=1)[: begins.sum()]
        flags = [pc.invert(pc.is_in(ambiguity, value_set=LETTERS[:UNKNOWN])), pc.invert(agrees).fill_null(False), place.is_null()]
        n = len(t.vendor)
        numbers = [np.bincount(t.of[x.to_numpy(zero_copy_only=False)], minlength=n) for x in flags]
        return np.arange(n), [pa.array(x, pa.int64()) for x in (*numbers, np.bincount(of[begins][lengths >= least], minlength=n))]

    return _each_trace(traces, 2, keys, _chosen(WARNINGS, None), counts)


def trace_integrity(traces: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Spacing of the locations, clipped samples, and lengths of the vendor's evidence against the calls."""
    steps = F.transform(F.slice("ploc", 2, F.size("ploc") - 1), lambda p, i: p - F.get("ploc", i))
    # compiled functions, not a lambda a sample
    flat = F.flatten("channels")
    clipped = F.size(flat) - F.size(F.array_remove(F.array_remove(flat, 32767), -32768))
    table = traces.where("error_class IS NULL AND size(ploc) >= 2").withColumn("__steps", steps)
    return table.select(
        *keys, F.size("ploc").alias("n_calls"), F.size(F.col("channels")[0]).alias("n_samples"), F.array_min("__steps").alias("min_spacing"), _median(F.col("__steps")).alias("median_spacing"),
        F.array_max("__steps").alias("max_spacing"), clipped.alias("clipped_samples"), (F.length("vendor_primary") != F.size("ploc")).alias("primary_length_differs"), (F.octet_length("vendor_quality") != F.size("ploc")).alias("quality_length_differs"),
    )
