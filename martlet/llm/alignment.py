"""Tokens of two tokenizers aligned over the same text.

Tokenizer A is byte-level (a file of the `tokenizers` library), B a sentencepiece model
with byte fallback.  Both see a leading space: A is given one, B adds it.

Each tokenizer's own spans are the coarse cuts: A tells character offsets, B the byte
spans of its immutable proto (which the release here hands out as "offset_mapping").  A cut
is trusted where a span ends on a whole character: for A where
the next token begins there, for B where the span is not empty.  Inside a character that
several tokens share, and at byte-fallback tokens, the cut is found from the last trusted
one by the lengths of the tokens' decoded bytes.  Texts whose joined token bytes are not
the text itself have no tokens.

Neither tokenizer joins characters across a single space between words, a line end before
one, or the place between a word and a stop.  (For A this is its splitting rule; for B it is checked on the entries.)  Texts are cut
there, and segments met before are not encoded again.

Byte offsets where tokens of both end cut them into groups.  Every overlap of an A token
with a B token is one link; ``pairs`` and ``times`` say how often a text links two ids.

Each row is a document, repeated rows too; doc_id may be null.  Null and empty texts have
no tokens: zeros and an empty groups text.  Other columns are not read, so names cannot
clash.  An empty table gives an empty one.  A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.words import texts_of
from martlet.session import work_path

#: Files of tokenizer A and B; read on the driver, sent with the function.
FILES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
#: Pairs sent to all tasks: those found in at least a HOT_PAIRS-th of all (document, pair)
#: entries.  There can be no more than HOT_PAIRS of them (16 bytes each); the others are joined.
HOT_PAIRS = 1 << 19
#: Texts in one batch of results.
BATCH = 128

ENCODED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups string, pairs array<long>, times array<int>")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible ones stand for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """The two tokenizers with the decoded bytes of their entries."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, at in names.items():
            self.a_bytes[at] = bytes(alphabet[c] for c in name)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(pieces)]
        self.fresh = self.b.encode("\n", return_type=int)  # what stands before a segment without a space
        #: No entry of B crosses the cuts of _SEGMENT, so segments are encoded alike alone and in a text.
        self.cuttable = not any("\n" in p or "▁" in p.lstrip("▁") or _INNER.search(p) for p in pieces)
        self.known = _Known(self)

    def tokens_a(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids and byte ends of the tokens."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans, raw = found.ids, found.offsets, text.encode()
        decoded = [self.a_bytes[k] for k in ids]
        if b"".join(decoded) != raw:
            return None
        at = range(len(raw) + 1) if len(raw) == len(text) else list(accumulate((len(c.encode()) for c in text), initial=0))
        ends, last = [], 0
        for k, (_, end) in enumerate(spans):
            whole = k + 1 == len(spans) or spans[k + 1][0] == end
            last = at[end] if whole else last + len(decoded[k])
            ends.append(last)
        return ids, ends

    def tokens_b(self, text: str) -> tuple[list[int], list[int]] | None:
        """As tokens_a, for a text that begins with a space or, within a document, behind a cut."""
        raw, inner = text.encode(), text[0] != " "
        found = self.b.encode("\n" + text if inner else text[1:], return_type="offset_mapping", return_bytes=True, num_threads=1)
        ids, spans = found["ids"], found["offsets"]
        if inner:  # the added space and the line end are no part of it
            if ids[:2] != self.fresh:
                return None
            ids, spans = ids[2:], spans[2:]
        decoded = [self.b_bytes[k] for k in ids]
        if b"".join(decoded) != raw:
            return None
        ends, last, shift = [], 0, -1 if inner else 1
        for (begin, end), entry in zip(spans, decoded):
            last = end + shift if end > begin else last + len(entry)
            ends.append(last)
        return ids, ends

    def segments(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]] | None:
        """For each of the segments, which are encoded in one piece: numbers of A tokens, B tokens and
        groups, the groups as text, and the links as ``a << 32 | b``.  None if a text does not come back."""
        whole = "".join(texts)
        a = self.tokens_a(whole)
        b = a and self.tokens_b(whole)
        if not a or not b:
            return None
        (a_ids, a_ends), (b_ids, b_ends) = a, b
        out, i, j, bound = [], 0, 0, 0
        for text in texts:
            bound += len(text.encode())
            links, groups, first, end = [], [], (i, j), -1
            a_from, b_from = i, j
            while end != bound:
                a_end, b_end = a_ends[i], b_ends[j]
                if a_end > bound or b_end > bound:
                    return None  # a token crosses two segments
                links.append(a_ids[i] << 32 | b_ids[j])
                i += a_end <= b_end
                j += b_end <= a_end
                if a_end == b_end:
                    groups.append(f"{','.join(map(str, a_ids[a_from:i]))}|{','.join(map(str, b_ids[b_from:j]))}")
                    a_from, b_from, end = i, j, a_end
            out.append((i - first[0], j - first[1], len(groups), ";".join(groups), array("q", links).tobytes()))
        return out

    def made(self, texts: list[str]) -> dict[str, tuple | None]:
        """The entries of new segments; those that may follow each other in a text are encoded together."""
        joined = sorted(t for t in texts if _FOLLOWS.match(t) and _ENDS.search(t))[::-1]  # a space before a line end
        out = dict(zip(joined, self.segments(joined) or ())) if len(joined) > 1 else {}
        return out | {t: (self.segments([t]) or [None])[0] for t in texts if t not in out}

    def document(self, raw: bytes) -> tuple[int, int, int, str, np.ndarray] | None:
        """As segments, for a whole text behind a space."""
        if not raw:
            return None
        text = " " + raw.decode()
        found = self.known.entries(_SEGMENT.split(text)) if self.cuttable else [None]
        if None in found:  # decided on the whole text
            found = self.segments([text])
            if found is None:
                return None
        n_a, n_b, n_groups, groups, links = zip(*found)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(links), np.int64)


#: Cuts before a single space or line end between characters that are neither, and between a
#: letter or digit and a stop: both tokenizers part there.
_SEGMENT = re.compile(r"(?<=[\w.,;:!?])(?=[ \n]\w)|(?<=[0-9A-Za-zß-öø-ɏ])(?=[.,;:!?])")
_INNER = re.compile(r"[0-9A-Za-zß-öø-ɏ][.,;:!?]")


#: What may begin and end a segment that stands behind another one.
_FOLLOWS, _ENDS = re.compile(r"[ \n]\w"), re.compile(r"[\w.,;:!?]\Z")


class _Known(dict):
    """Segments met before; a memory of bounded size, which results do not depend on."""

    ENTRIES, CHARACTERS = 300_000, 48

    def __init__(self, pair: Pair):
        self.pair, self.earlier = pair, {}

    def entries(self, texts: list[str]) -> list[tuple | None]:
        found = list(map(self.get, texts))
        if None not in found:
            return found
        new = {t: self.earlier.get(t) for t, f in zip(texts, found) if f is None}
        new |= self.pair.made([t for t, f in new.items() if f is None])
        kept = {t: f for t, f in new.items() if f is not None and len(t) <= self.CHARACTERS}
        if len(self) + len(kept) > self.ENTRIES:
            self.earlier = dict(self)
            self.clear()
        if len(kept) <= self.ENTRIES:
            self.update(kept)
        return [f or new[t] for t, f in zip(texts, found)]


_loaded: dict[tuple[bytes, bytes], Pair] = {}


def pair_of(files: tuple[bytes, bytes]) -> Pair:
    """One copy for each worker process."""
    if files not in _loaded:
        _loaded.clear()
        _loaded[files] = Pair(*files)
    return _loaded[files]


def encoded(docs: DataFrame, files: tuple[str, str] = FILES, hashed: bool = False) -> DataFrame:
    """A row for each document: sizes, the groups, and its distinct links with how often each occurs.

    ``hashed`` puts the groups' SHA-256 in place of their text, which is several times the document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(open(f, "rb").read() for f in files))

    def one(pair: Pair, raw: bytes):
        found = pair.document(raw)
        if found is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
        n_a, n_b, n_groups, groups, links = found
        if hashed:
            groups = hashlib.sha256(groups.encode()).hexdigest()
        values, times = np.unique(links, return_counts=True)
        return n_a, n_b, n_groups, len(links), groups, values, times.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(sent.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                made = [one(pair, raw or b"") for raw in texts_of(batch, "text")]
                offsets = pa.array(np.cumsum([0] + [len(m[5]) for m in made]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"),
                     *(pa.array([m[k] for m in made], pa.int64()) for k in range(4)),
                     pa.array([m[4] for m in made], pa.string()),
                     pa.ListArray.from_arrays(offsets, np.concatenate([m[5] for m in made])),
                     pa.ListArray.from_arrays(offsets, np.concatenate([m[6] for m in made]))],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents two ids are linked, and whether A's id has no higher count."""
    counts = _written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "counts")
    of = F.shiftright("pair", 32)
    most = counts.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))  # one row for each entry of A's vocabulary
    return counts.withColumn("a", of).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def weighed(rows: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of documents with links, by the counts over all documents."""
    counts = _written(pair_counts(rows), "pairs")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = counts.where(F.col("docs") * hot_pairs >= F.lit(total)).orderBy("pair").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "docs", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                pairs, row = batch.column("pairs"), batch.column("row").to_numpy()
                values, times = pairs.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(row)), np.diff(pairs.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
                met = known[at] == values if len(known) else np.zeros(len(values), bool)
                sums = np.zeros((2, len(row)), np.int64)
                np.add.at(sums[0], owner[met], times[met] * best[at[met]])
                np.add.at(sums[1], owner[met], times[met] * docs[at[met]])
                rest = ~met
                nothing = pa.nulls(len(row), pa.int64())
                blank = pa.nulls(int(rest.sum()), pa.int64())
                for columns in ((batch.column("row"), nothing, nothing, pa.array(sums[0]), pa.array(sums[1])),
                                (pa.array(row[owner[rest]]), pa.array(values[rest]), pa.array(times[rest]), blank, blank)):
                    yield pa.RecordBatch.from_arrays(list(columns), ["row", "pair", "times", "n_best", "count_sum"])

    found = _written(rows.select("row", "pairs", "times").mapInArrow(
        run, "row long, pair long, times long, n_best long, count_sum long"), "weighed")
    rare = found.where("pair IS NOT NULL").join(counts, "pair").select(
        "row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    return (found.where("pair IS NULL").select("row", "n_best", "count_sum").union(rare)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def digest(docs: DataFrame, files: tuple[str, str] = FILES) -> DataFrame:
    """The stated result: a row for each document."""
    rows = _written(encoded(docs, files, hashed=True), "encoded")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(weighed(rows), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
