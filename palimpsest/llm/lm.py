"""Language-model scores of texts, by a causal self-attention model on subword ids.

Words are folded to lower case and cut into the ids of a public vocabulary.
Word counts of all training documents give the unigram base and, cut into
subwords, the model's symbols: the frequent ids each, the rest as one that is
shared out by count.  A text is scored in overlapping windows; each token once.

All training documents are trained on, whole.  Hashes of their ids and texts
deal them to groups of about GROUP_WORDS words and order them there.  The first
group trains the model from its start; each other group goes on from there, and
the weights are averaged by the tokens seen.  Groups, their order and the sums
don't depend on how the input is partitioned or who trains what.

The base of a text needs the count of each of its words.  Counts grow with the
corpus, so they are joined, never broadcast: a task gives each distinct word of
a run of documents once, with where it occurs, and gets its count back.

Null and empty texts have one token, the end.  Without training documents the
base is 0 for every text and the model is the one it starts as.  Rows are
scored one by one, repeated ids included; ids are whole numbers or null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import CONTEXT, STRIDE, Adam, Attention
from .common import Workspace, bounded, hand_back, held_out, named

#: Symbols of the model: frequent ids, the end, and one for all other ids.
SYMBOLS, GROUPS = 2048, 32
#: Words of a group of training documents.
GROUP_WORDS = 2_500_000
#: Windows of a step, and the rate, in the first group and in the others.
FIRST_BATCH, FIRST_RATE, BATCH, RATE = 128, 0.03, 256, 0.01
#: The steps after which a rate has fallen by the square root of two.
RATE_STEPS = 100
#: A first group too small for this many steps is gone over again, this often at most.
FIRST_STEPS, FIRST_PASSES = 800, 20
#: Ids whose windows are put in random order together.
MIXED = 1 << 19
#: Tasks that train at once, at most: beyond, a task has several groups.
TASKS = 1 << 16
#: Parts of the weights that are summed apart.
CHUNKS = 64
#: Words that are looked up in a partition.
LOOKED_UP = 2_000_000
#: Bytes of text, and texts, in a run whose words are looked up together.
RUN_BYTES, RUN_ROWS = 16 << 20, 16384
#: Bytes of a row of payload.
PART_BYTES = 1 << 20
#: Ids that are scored at once.
SCORED = 200_000
#: The end of a text as a token; no word holds a space.
END = b" "


class Subwords:
    """Words of bytes to vocabulary ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        if self.end >= 1 << 16:  # ids, and the end, are packed in two bytes
            raise ValueError(f"{path}: {self.end} ids; vocabularies of up to 65,535 can be scored")
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts_word = np.zeros(self.end, bool)
        self.starts_word[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's start (and the end).  Words go through together: each begins with the one blank before it."""
        parts, starts, done = [], [], 0
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(part)).decode()), np.int64)
            at = np.flatnonzero(self.starts_word[ids])
            if len(at) != len(part):  # words with blanks of other scripts: one by one
                each = [self.encoding.encode_ordinary(" " + w.decode()) for w in part]
                ids = np.array([i for e in each for i in e], np.int64)
                at = np.cumsum([0] + [len(e) for e in each])[:-1]
            parts.append(ids)
            starts.append(at + done)
            done += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([*starts, [done]]).astype(np.int64)

    def cut(self, texts: pa.Array) -> Cut:
        """The texts' words by number, and each distinct word's ids."""
        numbers, ends, distinct = numbered_words(texts)
        return Cut(distinct, numbers, ends, *self.words(distinct.to_pylist()))


class Cut(NamedTuple):
    #: Distinct words, by number.
    distinct: pa.Array
    #: Of each word in turn.
    numbers: np.ndarray
    #: Where each text's words start, and the end.
    texts: np.ndarray
    #: Ids of the distinct words in a row, and where each word's start, and the end.
    ids: np.ndarray
    starts: np.ndarray

    def sizes(self) -> np.ndarray:
        """How many ids each text has."""
        per_word = np.diff(self.starts)[self.numbers]
        return np.diff(np.r_[0, np.cumsum(per_word)][self.texts])

    def stretches(self, most: int) -> Iterable[tuple[int, int]]:
        """(first, last) of texts that follow one another and have about most ids together, one at least."""
        ends, begin = np.cumsum(self.sizes()), 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield begin, end
            begin = end

    def expanded(self, first: int, last: int) -> np.ndarray:
        """The ids of the texts from first up to last, in a row."""
        numbers = self.numbers[self.texts[first] : self.texts[last]]
        size = np.diff(self.starts)[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.starts[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Symbols:
    """Vocabulary ids to the model's symbols, by their counts in training."""

    def __init__(self, counts: np.ndarray, documents: int, size: int = SYMBOLS, groups: int = GROUPS):
        end = len(counts)
        size = min(size, end + 2)
        counts = np.r_[counts, documents].astype(float) + 0.5
        order = np.r_[end, np.argsort(-counts[:end], kind="stable")][: size - 1]
        self.of = np.full(end + 1, size - 1, np.int64)
        self.of[order] = np.arange(len(order))
        self.counts = np.bincount(self.of, counts, minlength=size)
        self.share = np.log(counts / self.counts[self.of])  # of an id in its symbol
        mass = np.cumsum(np.sqrt(self.counts))
        group = np.minimum((mass / mass[-1] * groups).astype(int), groups - 1)
        self.starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.other = size - 1


def windows_of(ids: np.ndarray, sizes: np.ndarray, symbols: Symbols, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, as ids in a row, to (windows, what follows, first scored place, size, text of each window): each symbol after the start, and the end, is scored once."""
    end = len(symbols.of) - 1
    size = sizes + 1  # symbols to score
    starts = np.cumsum(size + 1) - size - 1  # where a text's start mark stands
    stream = np.full(size.sum() + len(sizes) + CONTEXT, end, np.int64)
    stream[np.arange(len(ids)) + np.repeat(starts + 1 - (np.cumsum(sizes) - sizes), sizes)] = ids
    stream = symbols.of.astype(np.uint16).take(stream)
    many = 1 + np.maximum(0, -(-(size - CONTEXT) // stride))
    text = np.repeat(np.arange(len(sizes)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(CONTEXT, size[text] - k * stride)
    at = starts[text] + k * stride
    every = np.lib.stride_tricks.sliding_window_view(np.append(stream, stream[-1:]), CONTEXT)
    return every[at], every[at + 1], np.where(k > 0, CONTEXT - stride, 0), length, text


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's number in turn, where each text's words start (and the end), and the distinct words by number.  Null texts have no words."""
    # only blanks stand at the ends of a text, so that an empty one is all that is cut into an empty word
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    split = pc.ascii_split_whitespace(trimmed.filter(pa.array(~blank)))
    coded = split.flatten().dictionary_encode()
    many = np.zeros(len(texts), np.int64)
    many[~blank] = pc.list_value_length(split).to_numpy()
    return coded.indices.to_numpy(), np.r_[0, np.cumsum(many)], coded.dictionary.cast(pa.binary())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end of each included; tasks sum first."""

    def run(batches):
        hand_back()
        for _, texts in bounded(batches, "text", RUN_BYTES, RUN_ROWS):
            numbers, ends, distinct = numbered_words(texts)
            word = pa.concat_arrays([distinct, pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([word, pa.array(np.r_[np.bincount(numbers, minlength=len(distinct)), len(texts)])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(counts: DataFrame, vocabulary: str) -> np.ndarray:
    """Counts of the vocabulary's ids in the words of a table (word, n)."""

    def run(batches):
        subwords = Subwords(vocabulary)
        total = np.zeros(subwords.end, np.int64)
        for batch in batches:
            known = batch.filter(pc.not_equal(batch.column(0), pa.scalar(END, pa.binary())))
            ids, starts = subwords.words(known.column(0).to_pylist())
            total += np.bincount(ids, np.repeat(known.column(1).to_numpy(), np.diff(starts)), minlength=subwords.end).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, subwords.end], pa.int32()), pa.array(np.r_[total[at], 0], pa.int64())], ["id", "n"])

    got = counts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    out = np.zeros(Subwords(vocabulary).end, np.int64)
    for r in got:
        if r.id < len(out):
            out[r.id] = r.n
    return out


class Fit:
    """Adam over windows as they come: random order among those that come together.  The rate falls with the steps done, so that the number of windows need not be known."""

    def __init__(self, model: Attention, rate: float, batch: int, seed: int = 2):
        self.model, self.rate, self.batch, self.rng = model, rate, batch, np.random.default_rng(seed)
        self.adam, self.steps, self.seen = Adam(model, rate), 0, 0
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, symbols: Symbols) -> None:
        """A text; texts are held until there are enough of them."""
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= MIXED:
            self.flush(symbols)

    def flush(self, symbols: Symbols) -> None:
        if self.held:
            # each token is learned once: training windows follow one another without overlap
            c, t, _, length, _ = windows_of(np.concatenate(self.held), np.array([len(i) for i in self.held]), symbols, CONTEXT)
            self.held, self.size = [], 0
            order = self.rng.permutation(len(c))
            for at in np.array_split(order, -(-len(order) // self.batch)):
                self.adam.rate = self.rate / np.sqrt(1 + self.steps / RATE_STEPS)
                real = np.arange(CONTEXT) < length[at][:, None]
                self.adam.step(self.model.gradients(c[at], t[at], real)[1])
                self.steps += 1
                self.seen += int(real.sum())


def _dealt(docs: DataFrame, groups: int) -> DataFrame:
    """(g, h, id, text): the rows with their groups, and what orders them there."""
    hashed = docs.withColumn("h", F.xxhash64("id", "text"))
    return hashed.select(F.pmod("h", F.lit(groups)).cast("int").alias("g"), "h", "id", "text")


def _cut(rows: DataFrame, vocabulary: str) -> DataFrame:
    """The rows (g, h, id, text) with ids in place of the text."""

    def run(batches):
        hand_back()
        subwords = Subwords(vocabulary)
        for part, texts in bounded(batches, "text", RUN_BYTES, RUN_ROWS):
            cut = subwords.cut(texts)
            sizes = cut.sizes()
            for begin, end in cut.stretches(SCORED):
                ends = np.r_[0, np.cumsum(sizes[begin:end])].astype(np.int32) * 2
                ids = cut.expanded(begin, end).astype(np.uint16)
                packed = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*part.slice(begin, end - begin).columns[:3], packed], ["g", "h", "id", "ids"])

    return rows.select("g", "h", "id", "text").mapInArrow(run, "g int, h long, id long, ids binary")


def _from_bytes(column) -> Iterable[np.ndarray]:
    return (np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in column)


def first_group(docs: DataFrame, model: Attention, symbols: Symbols, vocabulary: str, groups: int) -> None:
    """Trains on the first group, of bounded size, in one task."""
    sent = docs.sparkSession.sparkContext.broadcast((model, symbols))  # of fixed size

    def run(batches):
        model, symbols = sent.value[0].copy(), sent.value[1]  # the worker may see the broadcast again
        texts = [ids for batch in batches for ids in _from_bytes(batch.column(0))]
        fit = Fit(model, FIRST_RATE, FIRST_BATCH)
        for _ in range(FIRST_PASSES if texts else 0):
            for ids in texts:
                fit.add(ids, symbols)
            fit.flush(symbols)
            if fit.steps >= FIRST_STEPS:
                break
        yield pa.RecordBatch.from_arrays([pa.array([model.flat.tobytes()], pa.binary())], ["w"])

    rows = _cut(_dealt(docs, groups).where("g = 0"), vocabulary)
    for row in rows.repartition(1).sortWithinPartitions("h", "id").select("ids").mapInArrow(run, "w binary").collect():
        model.flat = np.frombuffer(row.w, np.float32)
    sent.unpersist()


def other_groups(docs: DataFrame, model: Attention, symbols: Symbols, vocabulary: str, groups: int) -> None:
    """Every other group goes on from the same weights over all its documents; the weights are averaged by the tokens seen.

    A task sums the weights of its groups, then salted parts of the tasks are
    summed, then these.  Weights are rounded to 20 binary places: as long as
    the sums hold them whole, their order plays no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, symbols))  # of fixed size
    tasks = min(groups - 1, TASKS)
    salts = 1 + min(63, tasks // 64)
    schema = "chunk int, salt int, n long, w binary"

    def packed(chunks, salt, n, weights):
        arrays = [pa.array(chunks, pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array(n, pa.int64()), pa.array([w.tobytes() for w in weights], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "salt", "n", "w"])

    def train(batches):
        model, symbols = sent.value[0].copy(), sent.value[1]  # the worker may see the broadcast again
        start, total, seen, now, fit = model.flat, np.zeros(len(model.flat)), 0, None, None

        def finished():
            fit.flush(symbols)
            return np.round(model.flat.astype(float) * 2**20) / 2**20 * fit.seen, fit.seen

        for batch in batches:
            for g, ids in zip(batch.column(0).to_pylist(), _from_bytes(batch.column(1)), strict=True):
                if g != now:
                    if fit:
                        w, n = finished()
                        total, seen = total + w, seen + n
                    model.flat, now = start, g
                    fit = Fit(model, RATE, BATCH)
                fit.add(ids, symbols)
        if fit:
            w, n = finished()
            yield packed(range(CHUNKS), TaskContext.get().partitionId() % salts, [seen + n] * CHUNKS, np.array_split(total + w, CHUNKS))

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for chunk, n, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                sums = held.setdefault(chunk, [0, 0.0])
                sums[0] += n
                sums[1] = sums[1] + np.frombuffer(w)
        if held:
            yield packed(list(held), 0, [v[0] for v in held.values()], [v[1] for v in held.values()])

    rows = _cut(_dealt(docs, groups).where("g > 0"), vocabulary)
    trained = rows.repartitionById(tasks, F.col("g") % tasks).sortWithinPartitions("g", "h", "id").select("g", "ids").mapInArrow(train, schema)
    if salts > 1:
        trained = trained.repartition(CHUNKS * salts, "chunk", "salt").mapInArrow(add, schema)
    got = sorted(trained.repartition("chunk").mapInArrow(add, schema).collect(), key=lambda r: r.chunk)  # as many rows as chunks
    if got:
        model.flat = np.concatenate([np.frombuffer(r.w) / r.n for r in got])
    sent.unpersist()


def learned(train: DataFrame, counts: DataFrame, total: int, end_count: int, vocabulary: str, group_words: int = GROUP_WORDS) -> tuple[Attention, Symbols]:
    """The model of all rows (id, text) of train, whose words counts has."""
    symbols = Symbols(subword_counts(counts, vocabulary), end_count)
    model = Attention(symbols.starts, symbols.counts)
    groups = max(1, -(-total // group_words))
    first_group(train, model, symbols, vocabulary, groups)
    if groups > 1:
        other_groups(train, model, symbols, vocabulary, groups)
    return model, symbols


def _scored(docs: DataFrame, model: Attention, symbols: Symbols, vocabulary: str) -> DataFrame:
    """Rows (word, run, place, payload): for each run of documents its distinct words with their numbers, and, as payload under negative places, what is known of its documents and where they hold which word how often."""
    sent = docs.sparkSession.sparkContext.broadcast((model.ready(), symbols))

    def batch(word, run, place, payload):
        arrays = [pa.array(word, pa.binary()), pa.array(np.full(len(word), run)), pa.array(place, pa.int32()), pa.array(payload, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["word", "run", "place", "payload"])

    def run(batches):
        model, symbols = sent.value
        subwords = Subwords(vocabulary)
        first = TaskContext.get().partitionId() << 32
        for k, (rows, texts) in enumerate(bounded(batches, "text", RUN_BYTES, RUN_ROWS)):
            cut = subwords.cut(texts)
            many, distinct = np.diff(cut.texts), cut.distinct
            size = cut.sizes()
            scores = np.zeros(len(texts))
            for begin, end in cut.stretches(SCORED):
                ids, own = cut.expanded(begin, end), size[begin:end]
                c, t, a, b, of = windows_of(ids, own, symbols)
                got = model.log_probabilities(c, a, b, t).astype(float)
                rare = np.flatnonzero(symbols.of[ids] == symbols.other)
                scores[begin:end] += np.bincount(np.repeat(of, b - a), got, minlength=end - begin)
                scores[begin:end] += np.bincount(np.searchsorted(np.cumsum(own), rare, "right"), symbols.share[ids[rare]], minlength=end - begin)
            key, times = np.unique(cut.numbers * np.int64(len(texts)) + np.repeat(np.arange(len(texts)), many), return_counts=True)
            number, place = np.divmod(key, len(texts))
            ids = rows.column(rows.schema.get_field_index("id"))
            blobs = (
                [pc.fill_null(ids, 0).to_numpy().astype(np.int64), pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.int64), many + 1, (scores / np.log(10)).view(np.int64)],
                [np.bincount(number, minlength=len(distinct)).astype(np.uint32)], [place.astype(np.uint16)], [times.astype(np.uint32)],
            )
            for kind, arrays in enumerate(blobs):
                raw = b"".join([x.tobytes() for x in arrays])
                for n, at in enumerate(range(0, len(raw), PART_BYTES)):
                    # no word begins with a space: these match nothing, and are dealt out evenly
                    yield batch([b" %d %d %d" % (first + k, kind, n)], first + k, [-1 - kind - len(blobs) * n], [raw[at : at + PART_BYTES]])
            for at in range(0, len(distinct), 10_000):
                part = distinct.slice(at, 10_000)
                yield batch(part, first + k, range(at, at + len(part)), [None] * len(part))

    return docs.select("id", "text").mapInArrow(run, "word binary, run long, place int, payload binary")


def _gathered(found: DataFrame, total: int, distinct: int, end_count: int) -> DataFrame:
    """Runs put together again: rows (run, place, payload, n), sorted by run, to a row for each document."""
    names = ["id", "n_tokens", "n_known", "base_score", "score"]
    scale = total + 0.5 * (distinct + 1)

    def out(parts):
        place, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        pieces = sorted((-1 - k, payload) for p in parts for k, payload in p[2])
        ids, known_id, sizes, scores = (blob(pieces, 0, np.int64)).reshape(4, -1)
        counts = np.zeros(int(place.max()) + 1 if len(place) else 0)
        counts[place] = n
        many, of, times = blob(pieces, 1, np.uint32), blob(pieces, 2, np.uint16), blob(pieces, 3, np.uint32)
        base = np.full(len(ids), np.log10((end_count + 0.5) / scale)) + np.bincount(of, times * np.repeat(np.log10((counts + 0.5) / scale), many), minlength=len(ids))
        known = np.bincount(of, times * np.repeat(counts > 0, many), minlength=len(ids)).astype(np.int64) + int(end_count > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=known_id == 0), pa.array(sizes), pa.array(known), pa.array(base), pa.array(scores.view(np.float64))], names)

    def blob(pieces, kind, dtype):
        return np.frombuffer(b"".join([payload for k, payload in pieces if k % 4 == kind]), dtype)

    def run(batches):
        held, now = [], None
        for batch in batches:
            runs = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else []
            for a, b in zip(starts, [*starts[1:], len(runs)], strict=True):
                if now is not None and runs[a] != now:
                    yield out(held)
                    held = []
                now = runs[a]
                part = batch.slice(a, b - a)
                place, n = part.column(1).to_numpy(), part.column(3).to_numpy()
                other = np.flatnonzero(place < 0)
                held.append((place[place >= 0], n[place >= 0], [(int(place[i]), part.column(2)[int(i)].as_py()) for i in other]))
        if held:
            yield out(held)

    schema = "id long, n_tokens long, n_known long, base_score double, score double"
    return _spread(found, total, "run").sortWithinPartitions("run").mapInArrow(run, schema)


def _spread(rows: DataFrame, words: int, key: str) -> DataFrame:
    """rows by key, in as many partitions as the words ask for where that is more than the session's number."""
    many = min(words // LOOKED_UP, 100_000)
    return rows.repartition(many, key) if many > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def scored(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, group_words: int = GROUP_WORDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, learned from train."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    work = Workspace(docs.sparkSession, "lm")
    docs, train = (d.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")) for d in (docs, train))
    counts = work.table(word_counts(train), "counts")
    total, end_count, distinct = totals(counts)
    model, symbols = learned(train, counts, total, end_count, vocabulary, group_words)
    rows = _spread(_scored(docs, model, symbols, vocabulary), total, "word").join(_spread(counts, total, "word"), "word", "left")
    found = rows.select("run", "place", "payload", F.coalesce("n", F.lit(0)).alias("n"))
    out = _gathered(found, total, distinct, end_count)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def totals(counts: DataFrame) -> tuple[int, int, int]:
    """All words, texts, and distinct words of a table of counts."""
    ends = F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))
    return tuple(counts.agg(F.coalesce(F.sum("n"), F.lit(0)), ends, F.count(F.lit(1))).first())


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned from the documents whose crc32 of the id leaves a remainder other than 1 by 5."""
    out = scored(docs, docs.where(~held_out(F.col(f"`{id_col}`"), 5, 1)), id_col, text_col)
    return out.select(named(id_col), held_out(named(id_col), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
