"""Mixture-controlled packing by deficit round-robin over source queues.

Every source has a queue of its documents' tokens and a share of the mixture. Each round visits the
queues in order and adds a queue's credit, in proportion to its share, to its deficit counter; the
queue then sends quanta of QUANTUM tokens as long as its counter covers them, and keeps the rest for
the next round. A sequence ends where it is full, so deficits are carried from window to window and
from partition to partition.

The order has a closed form: a quantum is sent in the first round whose credits cover the queue's
tokens up to its end, and what queue r has sent by the end of a round follows from its length and
credit alone. So the place of a quantum in the stream is a sum over the queues, and each task lays out
its own documents from the queues' lengths; nothing passes from task to task but the tokens that
earlier tasks put into each queue. The stream is cut into sequences of LENGTH; only the last can need
padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import new_path, stored, table, trimmed
from tidewatch.llm.shelf import Shelf
from tidewatch.session import ship

LENGTH = 2048
QUANTUM = 256
EOS = 1
TOKENIZER = "word_bpe_49k.json"
CREDIT = 1 << 16  # parts of a token in which credits are counted
SUMMED = 1024
GOLDEN = 0.6180339887498949
CACHE = 100_000
# White space of the tokenizer's pattern: of what str.split() takes, without \x1c-\x1f.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


class FastPieces:
    """Ids of many words at once, for a byte-level BPE whose merges end words with a suffix.

    Bytes become two letters each: one for the high half and whether the word ends here, one for
    the low half. The first ranks put the halves together, later ones are the merges in their
    order, so a rank-driven encoder over these letters does the same merges as the tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n"

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken

        model = json.load(open(path))["model"]
        suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}

        def letters(token: str) -> bytes:
            ends = token.endswith(suffix)
            data = [of_char[c] for c in (token[: -len(suffix)] if ends else token)]
            last = len(data) - 1
            return bytes(x for i, b in enumerate(data) for x in (64 + (b >> 4) + 16 * (ends and i == last), 96 + (b & 15)))

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = [c + end for end in ("", suffix) for c in of_char]
        ranks: dict[bytes, int] = {}
        self.ids = np.zeros(len(symbols) + len(pairs) + 1, np.int64)
        for token in [*symbols, *(a + b for a, b in pairs)]:
            if (key := letters(token)) not in ranks:
                self.ids[len(ranks)] = vocabulary[token]
                ranks[key] = len(ranks)
        self.separator = len(ranks)
        ranks[b"\n"] = self.separator
        for single in range(64, 112):
            ranks.setdefault(bytes([single]), len(ranks))
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[^ \n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(self.PATTERN)

    @staticmethod
    def takes(word: str) -> bool:
        """Words of scripts whose classes no version of Unicode has changed, without special tokens."""
        return (word.isascii() or max(word) < "\u0500") and "<|" not in word

    def encode(self, words: list[str], dtype: np.dtype) -> list[bytes]:
        import unicodedata

        text = unicodedata.normalize("NFC", "\n".join(words)).replace("\u03a3", "\u03c3").lower()
        data = np.frombuffer(" ".join(self.split.findall(text)).encode(), np.uint8)
        gap = (data == 32) | (data == 10)
        ends = np.r_[gap[1:], True] & ~gap
        out = np.empty((len(data), 2), np.uint8)
        out[:, 0] = np.where(gap, data, 64 + (data >> 4) + 16 * ends)
        out[:, 1] = np.where(gap, 32, 96 + (data & 15))
        ranks = np.array(self.encoding.encode_ordinary(out.tobytes().decode("ascii")), np.int64)
        inside = ranks != self.separator
        packed = self.ids[ranks[inside]].astype(dtype).tobytes()
        cuts = [0, *(np.cumsum(inside)[~inside] * dtype.itemsize).tolist(), len(packed)]
        return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class WordTokenizer:
    """Ids of whole texts, word by word: no token spans white space, so words are encoded once and kept."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.whole, self.known, self.old = path, None, {}, {}
        try:
            self.fast = FastPieces(path)
            size = int(self.fast.ids.max()) + 1
        except (KeyError, TypeError, ImportError):  # another kind of tokenizer
            self.fast = None
            size = self.tokenizer().get_vocab_size()
        self.dtype = np.dtype("<u2") if size < 60_000 else np.dtype("<u4")

    def tokenizer(self):
        """The library's own, loaded when a word needs it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    def words(self, text: str) -> list[str]:
        if any(c in text for c in ODD_SPACES):
            import re

            return [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w]
        return text.split()

    def encode(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        out: list[bytes] = [b""] * len(words)
        quick = [i for i, w in enumerate(words) if self.fast and self.fast.takes(w)]
        for at in range(0, len(quick), 20_000):
            part = quick[at : at + 20_000]
            for i, ids in zip(part, self.fast.encode([words[i] for i in part], self.dtype), strict=True):
                out[i] = ids
        chosen = set(quick)
        rest = [i for i in range(len(words)) if i not in chosen]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, found in zip(part, self.tokenizer().encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, self.dtype).tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE:  # what is used again moves over from the old generation
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        lacking = {w for words in split for w in words if w not in known}
        known.update((w, old[w]) for w in lacking if w in old)
        new = [w for w in lacking if w not in known]
        known.update(zip(new, self.encode(new), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that its words stay known from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


TOKENS = "doc_id long, queue string, part int, before long, ids binary, n long"


def _tokenize(path: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidewatch.llm.packing import tokenizer as shared

        part, sent = TaskContext.get().partitionId(), defaultdict(int)
        encoder = shared(path)
        end = np.array([eos], encoder.dtype).tobytes()
        wide = encoder.dtype.itemsize

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            ids = [x + end for x in encoder.ids([r[2] for r in rows])]
            sizes = [len(x) // wide for x in ids]
            before = []
            for (_, queue, _), n in zip(rows, sizes, strict=True):
                before.append(sent[queue])
                sent[queue] += n
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(before, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "queue", "part", "before", "ids", "n"])

        rows, held = [], 0
        for batch in batches:
            for doc, queue, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows.append((doc, queue, text.as_py() or ""))
                held += len(rows[-1][2])
                if held >= 1_000_000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)
            rows.clear()
        trimmed()

    return run


class Mixture:
    """Rounds and stream places of quanta; queues in order of name, with the share of each.

    Credits are counted in parts of a token (CREDIT), the largest share gets a quantum a round. Every
    counter starts below a quantum.
    """

    def __init__(self, lengths, shares, quantum: int):
        self.lengths, self.quantum = np.asarray(lengths, np.int64), quantum
        shares = np.asarray(shares, np.float64)
        # counters start at different parts of a quantum, so that queues of one share do not send in one round
        self.starts = (np.arange(len(shares)) * GOLDEN % 1.0 * quantum * CREDIT).astype(np.int64)
        self.credits = np.maximum(np.rint(shares / shares.max(initial=0.0) * quantum * CREDIT) if len(shares) else shares, 1).astype(np.int64)

    def round(self, q: int, k: np.ndarray) -> np.ndarray:
        """The round, from 1, in which quantum k of queue q is sent."""
        end = np.minimum((k + 1) * self.quantum, self.lengths[q])
        return np.maximum(-((self.starts[q] - end * CREDIT) // self.credits[q]), 1)

    def sent(self, rounds: np.ndarray, queues: slice) -> np.ndarray:
        """Tokens that the queues have sent by the end of each round."""
        out = np.zeros(len(rounds), np.int64)
        for at in range(queues.start, queues.stop, SUMMED):  # so many queues at once
            part = slice(at, min(at + SUMMED, queues.stop))
            lengths, given = self.lengths[part], np.where(rounds[:, None] > 0, rounds[:, None] * self.credits[part] + self.starts[part], 0)
            out += np.where(given >= lengths * CREDIT, lengths, given // (self.quantum * CREDIT) * self.quantum).sum(axis=1)
        return out

    def place(self, q: int, k: np.ndarray) -> np.ndarray:
        """Tokens in the stream before quantum k of queue q: the queues before it have had the round."""
        rounds = self.round(q, k)
        different, inverse = np.unique(rounds, return_inverse=True)
        others = self.sent(different, slice(0, q)) + self.sent(different - 1, slice(q + 1, len(self.lengths)))
        return others[inverse] + k * self.quantum


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def _lay_out(shelf: Shelf, quantum: int, length: int):
    def pieces(mixture: Mixture, q: int, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents at queue places first: the document, start, length and stream place of each piece."""
        low, high = first // quantum, (first + sizes - 1) // quantum
        count = high - low + 1
        doc = np.repeat(np.arange(len(first)), count)
        k = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        different, inverse = np.unique(k, return_inverse=True)
        place = mixture.place(q, different)[inverse]
        a = np.maximum(first[doc], k * quantum)
        b = np.minimum(first[doc] + sizes[doc], (k + 1) * quantum)
        at = place + a - k * quantum
        # cut at the borders of sequences; a quantum is no longer than a sequence
        border = (at // length + 1) * length
        cut = at + (b - a) > border
        left = np.where(cut, border - at, b - a)
        doc = np.r_[doc, doc[cut]]
        start = np.r_[a, a[cut] + left[cut]] - first[doc]
        size = np.r_[left, (b - a)[cut] - left[cut]]
        at = np.r_[at, border[cut]]
        order = np.lexsort((start, doc))
        doc, start, size, at = doc[order], start[order], size[order], at[order]
        # join what lies side by side in one sequence
        joins = np.r_[False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + size[:-1]) & (at[1:] // length == at[:-1] // length)] if len(doc) else np.zeros(0, bool)
        heads = np.flatnonzero(~joins)
        return doc[heads], start[heads], np.add.reduceat(size, heads) if len(heads) else size, at[heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(shelf.get("lengths"), shelf.get("shares"), quantum)
        ends, names = shelf.get("name_ends").tolist(), shelf.get("names").tobytes()
        number = {names[a:b].decode("utf-8", "surrogatepass"): q for q, (a, b) in enumerate(zip([0, *ends], ends, strict=False))}
        for batch in batches:
            ids, names = batch.column(2), batch.column(1)
            sizes, first = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            queues = np.array([number[x] for x in names.to_pylist()], np.int64)
            docs = batch.column(0)
            for q in np.unique(queues).tolist():
                rows = np.flatnonzero(queues == q)
                queue = names[int(rows[0])].as_py()
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    doc, start, size, place = pieces(mixture, q, first[part], sizes[part])
                    raw = [ids[int(i)].as_py() for i in part]
                    data = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(raw, sizes[part].tolist(), strict=True)]
                    crc = [zlib.crc32(data[d][4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                    cols = [docs.take(pa.array(part[doc])), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(sizes[part][doc]), pa.array(place // length), pa.array(place % length), pa.array([queue] * len(doc), pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, PIECE_NAMES)

    return run


PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame, path: str | None = None, weights: dict[str, float] | None = None, length: int = LENGTH, quantum: int = QUANTUM, eos: int = EOS) -> DataFrame:
    """One row per piece of a document in a sequence: the columns of PIECES.

    docs has doc_id, text and source; every source is a queue of its own, however many there are. weights
    gives target shares by source (those not named get 1); without it shares follow the sources'
    sizes, so all queues end together. With it, each window holds its targets as long as all queues
    last; what remains after a queue ends is shared among the others, and nothing is dropped. The
    list of sources with their sizes comes to the driver; tasks map it from the shared folder.

    Null texts count as empty: every row has at least its end id. Null sources are one queue.
    Rows that repeat, doc_ids too, are packed each for itself; a document of any length is cut
    over as many sequences as it needs. An empty table gives no pieces.
    """
    if quantum > length:
        raise ValueError("a quantum is at most a sequence long")
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path()
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("queue"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = stored(narrow.mapInArrow(_tokenize(path, eos), TOKENS), "tokens")
    sums = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    queues = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()
    names, lengths = [r["queue"] for r in queues], [r["n"] for r in queues]
    shares = [float(weights.get(n, 1.0)) for n in names] if weights else [float(n) for n in lengths]
    shelf = Shelf(new_path(spark, "mixture"))
    shelf.put("lengths", np.array(lengths, np.int64))
    shelf.put("shares", np.array(shares, np.float64))
    encoded = [n.encode("utf-8", "surrogatepass") for n in names]
    shelf.put("names", np.frombuffer(b"".join(encoded), np.uint8))
    shelf.put("name_ends", np.cumsum([len(n) for n in encoded], dtype=np.int64))
    starts = sums.selectExpr("queue", "part", "sum(n) OVER (PARTITION BY queue ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS begin")
    placed = tokens.join(starts, ["queue", "part"]).select("doc_id", "queue", "ids", "n", (F.col("begin") + F.col("before")).alias("first"))
    return placed.mapInArrow(_lay_out(shelf, quantum, length), PIECES)


def op1_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, in the shares their sources have; see packed()."""
    return packed(table(spark, sf_dir, "documents"))
