"""SentencePiece encoding with samples without replacement, and decoding.

A text's segmentations form a lattice. No piece crosses from a character to a following space or
holds a line feed, so the lattice is a chain of small ones, one per word. Perturbed A* over it:
the whole text's Gumbel value is drawn, a best path follows by ancestral sampling, and at every
word the paths that leave it there get a truncated Gumbel value together. The branch with the
largest value is expanded next and gives the next sample, until k are out. Samples are distinct by
construction; the best value not expanded is the threshold for inclusion scores.

Texts go through in groups. The different words of a group have their lattices built together: a
trie of the pieces is walked from all positions at once, and the mass from a position to its word's
end is summed for all positions at one distance from the end at a time. All words of all texts then
take their ancestral steps together, one piece a round. A step's uniform number is a hash of the
row key, the sample, the word's place and the step, so samples do not depend on the grouping.

The vocabulary has ranks, not probabilities, so a piece of rank r weighs -ALPHA * ln(r + 2), as
frequencies fall with rank. A character without a piece is spelled in bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import table, trimmed
from tidewatch.session import ship

SAMPLES = 2
ALPHA = 0.5
SEED = 11
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
GROUP_CHARS = 1_500_000  # texts of so many code points together are one group
HELD_IDS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(base: np.ndarray, number) -> np.ndarray:
    return _mixed(base + np.asarray(number).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


class Trie:
    """Pieces by their characters: node and next character lead to a node, through one open hash table."""

    def __init__(self, pieces: list[str]):
        children: dict[int, int] = {}
        self.piece = [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for char in piece:
                key = (node << 21) | ord(char)
                if key not in children:
                    children[key] = len(self.piece)
                    self.piece.append(-1)
                node = children[key]
            self.piece[node] = number
        self.piece = np.array(self.piece, np.int64)
        self.bits = max(4, (8 * len(children)).bit_length())
        size = 1 << self.bits
        keys, values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        sought, targets = np.array(list(children), np.int64), np.array(list(children.values()), np.int64)
        at = self._slot(sought)
        while len(sought):
            free = keys[at] == -1
            place, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            keys[place], values[place] = sought[chosen], targets[chosen]
            rest = np.ones(len(sought), bool)
            rest[chosen] = False
            sought, targets, at = sought[rest], targets[rest], (at[rest] + 1) & (size - 1)
        self.keys, self.values = keys, values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after each node and character; -1 where no piece goes on."""
        keys = (nodes << 21) | chars
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = np.array(normal, np.int64)
        self.weights = np.array([-alpha * math.log(2 - model.get_score(i)) for i in normal])
        self.trie = Trie([self.pieces[i] for i in normal])
        self.bytes = np.zeros(256, np.int64)
        data = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for i in range(size):
            if model.is_byte(i):
                value = int(self.pieces[i][3:5], 16)
                self.bytes[value], data[i] = i, bytes([value])
        self.last = -alpha * math.log(size + 2)
        # what each id stands for, one after the other
        self.lengths = np.fromiter(map(len, data), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space in front."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        text = self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(total)].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_VOCABULARIES: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    if (path, alpha) not in _VOCABULARIES:
        _VOCABULARIES[path, alpha] = Vocabulary(path, alpha)
    return _VOCABULARIES[path, alpha]


def words_of(text: str) -> list[str]:
    """A text's words, after a space in front (as the model has it); none for no text."""
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _utf8_size(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


class Lattices:
    """The lattices of different words.

    A row is a position of a word; rows lie in order of their distance from the word's end, and the
    edges of a row, widest first, side by side. log_p is an edge's log probability among all paths
    from its row to the end, target the row it leads to (rows: the end). An edge without a piece
    has the character it spells, as -1 - character, in place of an id.
    """

    def __init__(self, words: list[str], own: Vocabulary):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = len(chars)
        self.rows = n
        begins = np.cumsum(sizes) - sizes
        left = np.repeat(begins + sizes, sizes) - np.arange(n)
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        row_of = np.empty(n, np.int64)
        row_of[order] = np.arange(n)
        self.row_of, self.begins = row_of, begins
        nodes, at, count = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
        found, width = [], 0
        while at.size:
            nodes = own.trie.step(nodes, chars[at + width])
            width += 1
            ends = own.trie.piece[nodes]
            ends[nodes < 0] = -1
            if width == 1:  # every position has an edge of one character
                hit, ids = at, np.where(ends >= 0, own.ids[ends], -1 - chars)
                weights = np.where(ends >= 0, own.weights[ends], own.last * _utf8_size(chars))
            else:
                some = ends >= 0
                hit, ids, weights = at[some], own.ids[ends[some]], own.weights[ends[some]]
            found.append((hit, count[hit], ids, weights, width))
            count[hit] += 1
            on = (nodes >= 0) & (left[at] > width)
            at, nodes = at[on], nodes[on]
        self.first = np.r_[0, np.cumsum(count[order])]
        edges = int(self.first[-1])
        self.ids, self.target, self.log_p = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges)
        for hit, rank, ids, weights, width in found:
            slot = self.first[row_of[hit] + 1] - 1 - rank
            self.ids[slot], self.log_p[slot] = ids, weights
            self.target[slot] = np.where(left[hit] > width, row_of[np.minimum(hit + width, n - 1)], n)
        mass = np.zeros(n + 1)
        borders = np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            start, end = int(self.first[a]), int(self.first[b])
            score = self.log_p[start:end] + mass[self.target[start:end]]
            heads, many = self.first[a:b] - start, np.diff(self.first[a : b + 1])
            top = np.maximum.reduceat(score, heads)
            mass[a:b] = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, many)), heads))
            self.log_p[start:end] = score - np.repeat(mass[a:b], many)
        self.p = np.exp(self.log_p)
        self.width = np.where(self.ids >= 0, 1, _utf8_size(-1 - self.ids))  # ids of an edge
        self.own = own

    def starts(self, words: np.ndarray) -> np.ndarray:
        """The first rows of words, by number."""
        return self.row_of[self.begins[words]]

    def spelled(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For edges without a piece: ids of their bytes, as a matrix, and how many each has."""
        chars, sizes = -1 - self.ids[edges], self.width[edges]
        out = np.zeros((len(edges), 4), np.int64)
        for k in range(4):
            shift = 6 * np.maximum(sizes - 1 - k, 0)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[sizes]
            out[:, k] = self.own.bytes[(lead | (chars >> shift)) & 0xFF if k == 0 else 0x80 | ((chars >> shift) & 0x3F)]
        return out, sizes

    def walk(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path from each row to its word's end by ancestral sampling: its ids, all side by side, the
        number of ids of each path before it (and of all), and the log probability of each path."""
        n = len(rows)
        logs, sizes, trace = np.zeros(n), np.zeros(n, np.int64), []
        at, row, step = np.arange(n), rows, 0
        while at.size:
            u = _uniform(_numbered(keys[at], step))
            edge, last = self.first[row], self.first[row + 1] - 1
            u -= self.p[edge]
            open_ = np.flatnonzero((u >= 0) & (edge < last))
            while open_.size:
                edge[open_] += 1
                u[open_] -= self.p[edge[open_]]
                open_ = open_[(u[open_] >= 0) & (edge[open_] < last[open_])]
            logs[at] += self.log_p[edge]
            sizes[at] += self.width[edge]
            trace.append((at, edge))
            row = self.target[edge]
            on = row < self.rows
            at, row, step = at[on], row[on], step + 1
        begins = np.r_[0, np.cumsum(sizes)]
        ids, place = np.empty(int(begins[-1]), "<u4"), begins[:-1].copy()
        for at, edge in trace:
            found = self.ids[edge]
            plain = found >= 0
            ids[place[at[plain]]] = found[plain]
            if not plain.all():
                odd = np.flatnonzero(~plain)
                spelled, many = self.spelled(edge[odd])
                for k in range(4):
                    some = many > k
                    ids[place[at[odd[some]]] + k] = spelled[some, k]
            place[at] += self.width[edge]
        return ids, begins, logs

    def other(self, row: int, taken: list[tuple[float, tuple[int, ...]]], uniforms: Iterator[float]) -> tuple[float, tuple[int, ...]]:
        """A path from row that is none of those taken, by what mass they leave at every edge."""
        out: tuple[int, ...] = ()
        total, live = 0.0, taken
        while row < self.rows:
            options = []
            for e in range(int(self.first[row]), int(self.first[row + 1])):
                piece, p = int(self.ids[e]), float(self.log_p[e])
                ids = (piece,) if piece >= 0 else tuple(self.spelled(np.array([e]))[0][0, : int(self.width[e])].tolist())
                own = [t for t in live if t[1][len(out) : len(out) + len(ids)] == ids]
                mass = math.exp(p)
                if own:
                    mass -= sum(math.exp(t[0] - total) for t in own)
                    if mass < 1e-14:  # no path is left there but for rounding
                        continue
                options.append((mass, int(self.target[e]), ids, p, own))
            u = next(uniforms) * sum(o[0] for o in options)
            for chosen in options:
                u -= chosen[0]
                if u < 0:
                    break
            _, row, ids, p, live = chosen
            out, total = out + ids, total + p
        return total, out


def _truncated(phi: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values of log masses phi, given that none passes bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return phi - np.log(np.exp(phi - bound) - np.log(u))


class Sample:
    """A segmentation: ids by word, log probabilities, and the branches that leave it from word first on."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, logs: np.ndarray, first: int, value: float, rng: np.random.Generator):
        self.ids, self.begins, self.logs, self.first, self.value = ids, begins, logs, first, value
        self.before = np.r_[0.0, np.cumsum(logs)]
        self.taken: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        own = logs[first:]
        with np.errstate(divide="ignore"):
            phi = self.before[first:-1] + np.log(np.maximum(-np.expm1(np.minimum(own, 0.0)), 0.0))
        phi[own > -1e-12] = -np.inf
        self.values = _truncated(phi, value, rng.random(len(own)))

    @property
    def log_prob(self) -> float:
        return float(self.before[-1])

    def best(self) -> float:
        return float(self.values.max()) if len(self.values) else -math.inf

    def path(self, word: int) -> tuple[float, tuple[int, ...]]:
        return float(self.logs[word]), tuple(self.ids[self.begins[word] : self.begins[word + 1]].tolist())


class Text:
    """One text's samples so far."""

    def __init__(self, key, seed: int, start: int, size: int):
        self.hash = np.uint64(xxhash.xxh64_intdigest(str(key), seed))
        self.rng = np.random.Generator(np.random.PCG64(int(self.hash)))
        self.start, self.size = start, size
        self.samples: list[Sample] = []
        self.threshold = -math.inf

    def uniforms(self) -> Iterator[float]:
        while True:
            yield from self.rng.random(32).tolist()


def sampled(texts: list[str], keys: list, k: int, own: Vocabulary, seed: int = SEED) -> list[Text]:
    """k distinct segmentations of each text, best first, and the threshold: the largest value among
    those not drawn."""
    number: dict[str, int] = {}
    split = [words_of(t) for t in texts]
    for words in split:
        number.update(dict.fromkeys(words))
    number = dict(zip(number, range(len(number))))
    lattices = Lattices(list(number), own)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    begins = np.cumsum(sizes) - sizes
    rows = lattices.starts(np.fromiter((number[w] for words in split for w in words), np.int64, int(sizes.sum())))
    del number, split
    out = [Text(key, seed, int(b), int(n)) for key, b, n in zip(keys, begins, sizes, strict=True)]

    def suffixes(parts: list[tuple[Text, int]], sample: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """New paths for the words of texts from first on."""
        many = np.array([t.size - first for t, first in parts], np.int64)
        heads = np.cumsum(many) - many
        place = np.arange(int(many.sum())) - np.repeat(heads, many) + np.repeat(np.array([f for _, f in parts], np.int64), many)
        whose = np.repeat(np.array([t.start for t, _ in parts], np.int64), many) + place
        hashes = np.repeat(np.array([t.hash for t, _ in parts], np.uint64), many)
        ids, ends, logs = lattices.walk(rows[whose], _numbered(_numbered(hashes, sample + 1), place + 1))
        for head, n in zip(heads.tolist(), many.tolist(), strict=True):
            own_ends = ends[head : head + n + 1]
            yield ids[own_ends[0] : own_ends[-1]], own_ends - own_ends[0], logs[head : head + n]

    for text, (ids, ends, logs) in zip(out, suffixes([(t, 0) for t in out], 0), strict=True):
        value = -math.log(-math.log(text.rng.random()))
        text.samples.append(Sample(ids, ends, logs, 0, value, text.rng))
    for sample in range(1, k + 1):
        open_ = []
        for text in out:
            if len(text.samples) < sample:
                continue
            head = max(text.samples, key=Sample.best)
            value = head.best()
            text.threshold = value
            if sample == k or not math.isfinite(value):
                continue
            word = head.first + int(head.values.argmax())
            taken = head.taken.setdefault(word, [head.path(word)])
            other = lattices.other(int(rows[text.start + word]), taken, text.uniforms())
            taken.append(other)
            left = 1.0 - sum(math.exp(p) for p, _ in taken)
            phi = head.before[word] + math.log(left) if left > 1e-12 else -math.inf
            head.values[word - head.first] = _truncated(np.array([phi]), value, text.rng.random(1))[0] if math.isfinite(phi) else -math.inf
            open_.append((text, head, word, other, value))
        for (text, head, word, other, value), (ids, ends, logs) in zip(open_, suffixes([(o[0], o[2] + 1) for o in open_], sample), strict=True):
            kept = int(head.begins[word])
            whole = np.concatenate([head.ids[:kept], np.array(other[1], "<u4"), ids])
            begins_ = np.concatenate([head.begins[: word + 1], kept + len(other[1]) + ends])
            text.samples.append(Sample(whole, begins_, np.r_[head.logs[:word], other[0], logs], word + 1, value, text.rng))
    return out


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Logarithm of the probability that a path passes the threshold; it underflows for no text."""
    if not math.isfinite(threshold):
        return 0.0
    odds = log_prob - threshold
    return odds if odds < -30 else math.log(-math.expm1(-math.exp(min(odds, 30.0))))


ROWS = "doc_id long, rank int, ids binary, n_tokens long, log_prob double, perturbed double, log_inclusion double"


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of a batch, in groups of about GROUP_CHARS."""
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        keys.append(key)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= GROUP_CHARS:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _encode(path: str, k: int, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewatch.llm.gumbel import vocabulary as shared

        own = shared(path, alpha)
        for batch in batches:
            for keys, texts in _groups(batch):
                rows: list[tuple] = []
                held = 0
                for key, text in zip(keys, sampled(texts, keys, k, own, seed), strict=True):
                    for rank, s in enumerate(text.samples, 1):
                        rows.append((key, rank, s.ids.tobytes(), len(s.ids), s.log_prob, s.value, log_inclusion(s.log_prob, text.threshold)))
                        held += len(s.ids)
                    text.samples.clear()
                    if held > HELD_IDS:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)
        trimmed()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, k: int = SAMPLES, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """k distinct sampled segmentations of every whole text, or all where there are fewer: ROWS.

    ids are little-endian unsigned 32-bit. A row's samples depend on its doc_id, text and seed only,
    so repeated rows get equal samples. Null and empty texts have one segmentation, without ids.
    Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(_encode(path or model_path(), k, alpha, seed), ROWS)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (with ids) and their text; a literal lower one-eighth block reads as a space."""
    ship(rows.sparkSession)
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewatch.llm.gumbel import vocabulary as shared

        own = shared(where)
        for batch in batches:
            at = batch.schema.names.index("ids")
            found = [own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, text string")


def op7_gumbel_pieces(spark, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every whole document, decoded again: checksums and scores.

    Null texts count as empty and have one segmentation without ids; see encoded() for the rest.
    """
    out = decoded(encoded(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "rank", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "log_prob", "perturbed", "log_inclusion")
