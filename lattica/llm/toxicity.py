"""Operator 8: toxicity by compression distance to two trained zstandard dictionaries.

A document is cut into windows of ``WINDOW`` words. Each is compressed with two dictionaries, and its
distance is the difference of the two lengths: positive where toxic text explains the window better. A
document is toxic when too large a share of its windows, or too many in some stretch, are nearer to
toxic text than a calibrated margin.

Both dictionaries are trained by zstandard's cover trainer. The ordinary one is trained on windows of
ordinary text. Most words of a toxic document are ordinary too, and a dictionary trained on all of them
differs from the ordinary one mainly by chance. The toxic dictionary is therefore trained on what
ordinary text leaves open, the words that recur in toxic documents and begin like hardly any word of
ordinary ones, and laid behind the ordinary dictionary; there the ordinary one has zeros, so that both
reach all else at the same distance and at the same cost.

Windows are written with one byte a letter, a hash of the word's beginning up to that letter, so that
zstandard matches words from their beginnings on and never syllables in their midst.

Every labelled document counts, with all of its windows: three fifths of the ids give the words that
are told apart and train the dictionaries, the rest give the margin and the thresholds. A trainer holds
``TRAIN_BYTES``; where there is more, each part of the windows trains a dictionary of ``WIDER`` times the
size, and these train the next one, until a single part is left.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.textkernel import _pieces, slices
from lattica.runtime import ship, stored

#: Bytes of windows in one run of the trainer, and how much larger than the last one the dictionaries of parts are.
TRAIN_BYTES, WIDER = 1 << 23, 4
#: Labelled ids, and ids of near copies, up to this count are broadcast; beyond it they are joined by a shuffle. The
#: result is the same.
MOST_BROADCAST = 2_000_000
WINDOW, STRETCH = 12, 16
ORDINARY_BYTES, TOXIC_BYTES = 1 << 16, 1 << 10
#: Letters of the shortest beginnings looked at, the share of ordinary documents that makes a beginning ordinary, the
#: share of toxic ones in which it must recur, and how many of the words left open make a sample for the trainer.
BEGINNING, USUAL, RECURS, OPEN_WINDOW = 3, 0.002, 0.01, 12
MARGINS = tuple(range(1, 9))
MOST_FALSE = 0.005
MOST_CACHED = 200_000
#: How a trained dictionary begins, and the three offsets that the trainer always writes before the content.
_MAGIC, _OFFSETS = (b"".join(k.to_bytes(4, "little") for k in ks) for ks in ((0xEC30A437,), (1, 4, 8)))
_SPLIT, _FOREIGN = re.compile(r"[\W_]+"), re.compile(r"[^\w\x00-\x7f]+")
#: Bytes of UTF-8 that belong to words, once other characters beyond ASCII are gone.
_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Where the hash of a word begins and what each step multiplies it by.
_SEED, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Characters coded at a time, windows compressed at a time, and bytes of the longest word coded together with all others.
SLICE, BLOCK, LONG = 1 << 20, 1 << 14, 64


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    words = _SPLIT.split(text.lower())  # only the outer two can be empty
    return words[not words[0] : len(words) - (not words[-1])]


def beginning_codes(word: str) -> bytes:
    """A byte for each byte of the word and one for its end, each a hash of everything up to it."""
    h, out = _SEED, bytearray()
    for byte in word.encode("utf-8", "replace") + b" ":
        h = (h ^ byte) * _PRIME & 0xFFFFFFFFFFFFFFFF
        out.append((h ^ h >> 32) >> 11 & 255)
    return bytes(out)


class Coder:
    """Windows of coded words; codes of words are kept, as most words come again."""

    def __init__(self):
        self.codes: dict[str, bytes] = {}

    def __call__(self, words: list[str], size: int = WINDOW) -> list[bytes]:
        codes = self.codes
        if len(codes) > MOST_CACHED:
            codes.clear()
        for w in words:
            if w not in codes:
                codes[w] = beginning_codes(w)
        return [b"".join([codes[w] for w in words[i : i + size]]) for i in range(0, len(words), size)]


def _letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which all that separates words is ASCII."""
    if not text:
        return b""
    low = text.lower()
    return (low if low.isascii() else _FOREIGN.sub(" ", low)).encode("utf-8", "replace")


def _word_codes(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``beginning_codes`` of all words end to end, where each word starts in the piece, and where its codes end.

    All words take their next letter at once, the longest first, so that those with letters left are in front.
    """
    raw = np.frombuffer(piece + b" ", dtype=np.uint8)
    inside = _WORDY[raw]
    raw = np.where(inside, raw, np.uint8(32))
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, length = edges[0::2], edges[1::2] - edges[0::2]
    end = np.cumsum(length + 1)
    begin = end - length - 1
    codes = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    order = np.argsort(-length, kind="stable")
    falling = -length[order]
    alone = int(np.searchsorted(falling, -LONG))
    for i in order[:alone].tolist():
        codes[begin[i] : end[i]] = np.frombuffer(beginning_codes(raw[start[i] : start[i] + length[i]].tobytes().decode()), dtype=np.uint8)
    order, falling = order[alone:], falling[alone:]
    read, write, h = start[order], begin[order], np.full(len(order), _SEED, dtype=np.uint64)
    for k in range(1 - int(falling[0]) if len(order) else 0):
        live = int(np.searchsorted(falling, -k, side="right"))
        read, write, h = read[:live], write[:live], h[:live]
        h = (h ^ raw[read + k]) * np.uint64(_PRIME)
        codes[write + k] = (h ^ h >> np.uint64(32)) >> np.uint64(11) & np.uint64(255)
    return codes, start, end


def coded_windows(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The windows of all texts end to end, as ``Coder`` writes those of ``words_of``, and how many each text has."""
    parts = [_letters(t) for t in texts]
    at = size = 0
    codes, starts, bounds = [], [], [np.zeros(1, dtype=np.int64)]
    for piece in _pieces(b" ".join(parts) + b" "):
        code, start, end = _word_codes(piece)
        codes.append(code.tobytes())
        starts.append(start + at)
        bounds.append(end + size)
        at, size = at + len(piece), size + len(code)
    words = np.diff(np.searchsorted(np.concatenate(starts), np.cumsum([len(p) + 1 for p in parts])), prepend=0)
    counts = -(-words // WINDOW)
    last = np.repeat(np.cumsum(words), counts)
    first = last - np.repeat(words, counts) + WINDOW * (np.arange(len(last)) - np.repeat(np.cumsum(counts) - counts, counts))
    data, bound = b"".join(codes), np.concatenate(bounds)
    return [data[a:b] for a, b in zip(bound[first].tolist(), bound[np.minimum(first + WINDOW, last)].tolist())], counts


def _shape(size: int) -> zstandard.ZstdCompressionParameters:
    log = max(14, size.bit_length() + 1)
    return zstandard.ZstdCompressionParameters(
        window_log=log, chain_log=log, hash_log=log - 1, search_log=3, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shape = _shape(len(dictionary))
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(compression_params=shape)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=shape)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on ``samples``; the last of them as they are where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Distance:
    """The two dictionaries and the thresholds; small enough to travel with the plan."""

    toxic: bytes = b""
    ordinary: bytes = b""
    margin: int = 0
    share: float = math.inf
    stretch: float = math.inf

    def distances(self):
        """A function from texts to how many bytes each window of each of them is nearer to toxic text."""
        toxic, ordinary = compressor(self.toxic), compressor(self.ordinary)
        known: dict[bytes, int] = {}

        def of(windows: list[bytes]) -> list[int]:
            if len(known) > MOST_CACHED:
                known.clear()
            new = [w for w in dict.fromkeys(windows) if w not in known]  # copies of a text have the same windows
            plain = [len(ordinary.compress(w)) for w in new]  # one dictionary at a time costs less than both in turn
            known.update(zip(new, [n - len(toxic.compress(w)) for n, w in zip(plain, new)]))
            return [known[w] for w in windows]

        def each(texts: pd.Series) -> Iterator[np.ndarray]:
            texts = texts.tolist()
            for lo, hi in slices([len(t or "") for t in texts], SLICE):
                windows, counts = coded_windows(texts[lo:hi])
                found = np.array([d for i in range(0, len(windows), BLOCK) for d in of(windows[i : i + BLOCK])], dtype=np.int64)
                upto = np.cumsum(counts).tolist()
                yield from (found[a:b] for a, b in zip([0, *upto], upto))

        return each


def measure(near: np.ndarray) -> tuple[float, int]:
    """Share of near windows, and the most of them in any ``STRETCH`` windows."""
    if not near.any():
        return 0.0, 0
    total = np.concatenate(([0], np.cumsum(near)))
    return float(near.mean()), int((total[min(STRETCH, len(near)) :] - total[: max(1, len(total) - STRETCH)]).max())


def _least(words: list[str], known: dict[str, list[int]]) -> list[int]:
    """Six minimum word hashes over the long words, or over all where none is long."""
    own = set(words)
    if len(known) > MOST_CACHED:
        known.clear()
    hashes = []
    for w in [w for w in own if len(w) >= 7] or own:
        if w not in known:
            code = w.encode("utf-8", "replace")
            known[w] = [zlib.crc32(code, 0x9E3779B1 * (k + 1) & 0xFFFFFFFF) for k in range(6)]
        hashes.append(known[w])
    return [min(column) for column in zip(*hashes)]


def _chosen(ids: DataFrame) -> DataFrame:
    """``ids``, stored, and marked to be broadcast where they are few."""
    held = stored(ids)
    return F.broadcast(held) if held.count() <= MOST_BROADCAST else held


def _apart(rows: DataFrame) -> DataFrame:
    """The documents without those that share half of six minimum word hashes with an earlier one of their class."""
    place = F.struct("doc_id", "node").alias("place")
    codes = rows.select("toxic", place, F.posexplode("least").alias("k", "code"))
    earliest = codes.groupBy("toxic", "k", "code").agg(F.min("place").alias("earliest"))
    shared = codes.join(earliest, ["toxic", "k", "code"]).where("earliest < place").groupBy("place").count().where("count >= 3")
    return rows.join(_chosen(shared.select("place.doc_id", "place.node")), ["doc_id", "node"], "left_anti")


def _beginnings(word: str) -> list[str]:
    """Beginnings of the word of ``BEGINNING`` to 64 letters, and the whole word with its end."""
    return [*(word[:k] for k in range(min(BEGINNING, len(word)), min(len(word), 64) + 1)), word + " "]


def _counted(among: frozenset[str] | None):
    """In how many documents each beginning, or each of ``among``, occurs, added up as far as a task holds them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        known: dict[str, list[str]] = {}

        def sums() -> pd.DataFrame:
            out = pd.DataFrame({"beginning": list(counts), "n": list(counts.values())})
            counts.clear()
            return out

        for rows in batches:
            for text in rows["words"]:
                if len(known) > MOST_CACHED:
                    known.clear()
                own: set[str] = set()
                for w in set(text.split(" ")):
                    if w not in known:
                        known[w] = [b for b in _beginnings(w) if among is None or b in among]
                    own.update(known[w])
                counts.update(own)
                if len(counts) > MOST_CACHED:
                    yield sums()
        yield sums()

    return count


def _telling(rows: DataFrame, ordinary: int, toxic: int) -> frozenset[str]:
    """The beginnings that recur in toxic documents and are those of hardly any word of ordinary ones.

    Those that recur are in one in a hundred toxic documents, so there are at most a hundred times as many as in one document.
    """

    def counts(kind: int, among: frozenset[str] | None = None) -> DataFrame:
        found = rows.where(F.col("toxic") == kind).select("words").mapInPandas(_counted(among), "beginning string, n long")
        return found.groupBy("beginning").agg(F.sum("n").alias("n"))

    most, least = max(2, USUAL * ordinary), max(3, RECURS * toxic)
    recur = frozenset(r.beginning for r in counts(1).where(F.col("n") >= least).collect())
    return recur - {r.beginning for r in counts(0, recur).where(F.col("n") >= most).collect()}


def _left(telling: frozenset[str]) -> Column:
    """Of ``words``, those with a telling beginning."""

    @F.pandas_udf("string")
    def left(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, bool] = {}
        for texts in batches:
            out = []
            for text in texts:
                words = text.split(" ")
                if len(known) > MOST_CACHED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = not telling.isdisjoint(_beginnings(w))
                out.append(" ".join([w for w in words if known[w]]))
            yield pd.Series(out, dtype=object)

    return left("words")


def _content(dictionary: bytes) -> bytes:
    """What a trained dictionary holds behind its statistics."""
    at = dictionary.find(_OFFSETS) if dictionary.startswith(_MAGIC) else -1
    return dictionary[at + len(_OFFSETS) :] if at >= 0 else dictionary


def dictionary(texts: DataFrame, size: int, segment: int, window: int) -> bytes:
    """A dictionary trained on the windows of all ``(doc_id, node, words)``; part by part where they outgrow one trainer."""
    rows = texts.select("doc_id", "node", (F.octet_length("words") + 1).cast("long").alias("bytes"), F.col("words").cast("binary").alias("data"))
    first = True
    while total := rows.agg(F.sum("bytes")).first()[0]:
        parts = -(-total // TRAIN_BYTES)
        rows = stored(rows.groupBy(F.pmod("node", F.lit(parts))).applyInPandas(_trainer(size, segment, window, first, parts == 1), "doc_id long, node long, bytes long, data binary"))
        if parts == 1:
            return bytes(rows.first().data)
        first = False
    return b""


def _trainer(size: int, segment: int, window: int, first: bool, last: bool):
    most, wider, offsets = TRAIN_BYTES, WIDER * size, 3 * segment

    def train_part(rows: pd.DataFrame) -> pd.DataFrame:
        coded, out, samples, held = Coder(), [], [], 0

        def end() -> None:
            made = trained(samples, size if last else wider, segment)
            out.append(made if last else _content(made))
            samples.clear()

        for data in rows.sort_values(["doc_id", "node"], kind="stable")["data"]:
            new = coded(data.decode().split(" "), window) if first else [data[i : i + offsets] for i in range(0, len(data), offsets)]
            for sample in new:
                samples.append(sample)
                held += len(sample)
                if held > 2 * most and not last:  # a part with long documents
                    end()
                    held = 0
        if samples:
            end()
        at = int(rows["node"].min())
        return pd.DataFrame({"doc_id": range(len(out)), "node": [at + i for i in range(len(out))], "bytes": [len(x) for x in out], "data": out})

    return train_part


def build(rows: DataFrame) -> Distance:
    """Dictionaries from the words of labelled documents; near copies count once, or their chance words would look telling."""
    kept = _apart(rows)
    n = {r.toxic: r["count"] for r in kept.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Distance()
    open_words = stored(kept.where("toxic = 1").select("doc_id", "node", _left(_telling(kept, n[0], n[1])).alias("words"))).where("words <> ''")
    own = dictionary(open_words, TOXIC_BYTES, 32, OPEN_WINDOW)
    base = dictionary(kept.where("toxic = 0"), ORDINARY_BYTES, 24, WINDOW) if own else b""
    return Distance(base + own, base + bytes(len(own))) if base and own else Distance()


def quantile(values: list[int], counts: list[int], q: float) -> float:
    """That of numbers of which each of ``values``, in order, occurs so often."""
    upto = np.cumsum(counts)
    at = q * (int(upto[-1]) - 1)
    low, high = (values[int(np.searchsorted(upto, k, side="right"))] for k in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def calibrate(model: Distance, figures: DataFrame) -> Distance:
    """Margin and thresholds from ``(toxic, k, share, stretch)`` of documents the dictionaries haven't seen, k the margin's place.

    For each margin the share is the least at which at most ``MOST_FALSE`` of ordinary documents are
    called toxic; the margin that finds the most toxic ones is taken, the larger where two find as many.
    """
    counts = stored(figures.groupBy("k", "share", "stretch").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    n = counts.where("k = 0").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not n.bad or not n.good:
        return Distance()
    falling = Window.partitionBy("k").orderBy(F.desc("share"))
    upto = falling.rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.where("share > 0").groupBy("k", "share").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    steps = steps.select("k", "share", F.sum("bad").over(upto).alias("bad"), F.sum("good").over(upto).alias("good"), F.lead("share", 1, 0.0).over(falling).alias("lower"))
    least = steps.where(F.col("good") / n.good <= MOST_FALSE).groupBy("k").agg(F.min(F.struct("share", "lower", "bad", "good")).alias("s")).collect()
    best = max(((r.s.bad / n.bad - r.s.good / n.good, MARGINS[r.k], (r.s.lower + r.s.share) / 2, r.k) for r in least), default=(0.0,))
    if best[0] <= 0:
        return model
    _, model.margin, model.share, k = best
    good = counts.where(F.col("k") == k).groupBy("stretch").agg(F.sum("good").alias("good")).where("good > 0").orderBy("stretch").collect()
    # A stretch is enough where twice as many windows as in any ordinary document lie close together.
    model.stretch = float(2 * max(2, quantile([r.stretch for r in good], [r.good for r in good], 0.999)))
    return model


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a label: ``(doc_id, node, text, toxic, first)``, equal rows with equal nodes."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = _chosen(own.withColumn("first", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) < 3))
    return docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("node", F.xxhash64("doc_id", "text"))


def train(docs: DataFrame, labels: DataFrame) -> Distance:
    """Dictionaries from three fifths of the labelled documents, thresholds from the rest.

    Without labelled documents of both classes in both parts nothing is ever called toxic. Label rows
    without an id or a label are left out; repeated ones count as their mean. Different texts of one id
    all have its label; repeated rows count once.
    """
    ship(docs.sparkSession)
    rows = _labelled(docs, labels)

    @F.pandas_udf("words string, least array<long>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for texts in batches:
            words = [words_of(t) for t in texts]
            yield pd.DataFrame({"words": [" ".join(w) for w in words], "least": [_least(w, known) for w in words]})

    first = rows.where("first").select("doc_id", "node", "toxic", "text").distinct()
    model = build(stored(first.select("doc_id", "node", "toxic", split("text").alias("f")).select("doc_id", "node", "toxic", "f.words", "f.least")).where("words <> ''"))
    if not model.toxic:
        return model

    @F.pandas_udf("array<struct<share:double,stretch:int>>")
    def figures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.distances()
        for texts in batches:
            yield pd.Series([[dict(zip(("share", "stretch"), measure(d >= m))) for m in MARGINS] for d in of(texts)], dtype=object)

    # Stored before they are taken apart, or the plan would also score texts without a label.
    second = stored(rows.where("NOT first").select("doc_id", "node", "toxic", figures("text").alias("f"))).distinct()
    return calibrate(model, second.select("toxic", F.posexplode("f").alias("k", "f")).select("toxic", "k", "f.share", "f.stretch"))


def scorer(model: Distance) -> Column:
    @F.pandas_udf("share double, stretch int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = model.distances() if model.margin else None
        for texts in batches:
            out = [measure(d >= model.margin) for d in of(texts)] if of else [(0.0, 0)] * len(texts)
            yield pd.DataFrame({"share": pd.Series([s for s, _ in out], dtype="float64"), "stretch": pd.Series([n for _, n in out], dtype="int32")})

    return score


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, share, stretch, toxic)`` for each row of ``docs``.

    ``share`` is the part of its windows near toxic text and ``stretch`` the most of them in any
    ``STRETCH`` windows. Every window of every text is compressed. Narrow: one pass, no shuffle. Null,
    empty and wordless texts aren't toxic; a text of any length, a single word of a million letters
    too, is read to its end; repeated rows score alike; an empty table gives no rows; other columns
    aren't read.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("s"))
    said = (F.col("s.share") >= F.lit(model.share)) | (F.col("s.stretch") >= F.lit(model.stretch))
    return scored.select("doc_id", "s.share", "s.stretch", said.alias("toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
