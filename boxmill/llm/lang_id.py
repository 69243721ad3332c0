"""Language identification: scripts narrow the candidates, Viterbi with a switching penalty labels the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.arrow_text import U, buffers, mix, slices
from boxmill.llm.tables import table

#: Hash buckets of letter trigrams; with the languages they bound what the driver collects and sends.
BUCKETS = 1 << 16
#: Added to every trigram's count.
ALPHA = 0.5
#: Nats that a change of language between two words costs.
SWITCH = 8.0
#: A language uses a script if it has at least this share of its letters in it.
SCRIPT_SHARE = 0.005
#: Bytes of text whose words are decoded together, with FEW languages; with more of them fewer, as each word has a number for each.
GROUP_BYTES, FEW = 4 << 20, 8
#: Numbers of letters and languages that are added up at once.
CELLS = 1 << 21
UNKNOWN = "und"
#: The driver and every worker hold BUCKETS numbers of 4 bytes for each language (64 MB for so many, some copies of that in the driver for a moment), a worker that counts of 8.
MOST_LANGUAGES = 256
#: First and last code points of scripts. Letters outside are of script 0.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x3FFFF),
]
N_SCRIPTS = 1 + len({name for name, _, _ in SCRIPTS})


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter or 0 if it is no letter, and the number of its script."""
    letter = np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) for c in map(chr, range(0x110000))), np.uint32, 0x110000)
    letter[np.fromiter((unicodedata.category(chr(i))[0] != "L" for i in range(0x110000)), bool, 0x110000)] = 0
    script, numbers = np.zeros(0x110000, np.uint8), {}
    for name, first, last in SCRIPTS:
        script[first : last + 1] = numbers.setdefault(name, len(numbers) + 1)
    return letter, script


@dataclass
class Words:
    """The letters of some texts, one after the other: their trigrams' buckets, and words as runs of letters."""

    bucket: np.ndarray  # of each letter
    script: np.ndarray  # of each word, by its first letter
    starts: np.ndarray  # of each word, among the letters
    lengths: np.ndarray  # of each word
    begins: np.ndarray  # of each word, in its text's code points
    first: np.ndarray  # word of each text, and the number of words


def split_words(texts: pa.Array) -> Words:
    letter_of, script_of = _tables()
    data, offsets = buffers(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letters = letter_of[points]
    # Texts and words are set apart by a zero on either side.
    padded = np.zeros(len(points) + 2, np.uint64)
    padded[1:-1] = letters
    is_letter = letters > 0
    begin = is_letter.copy()
    begin[1:] &= ~is_letter[:-1]
    cuts = at[(at > 0) & (at < len(points))]
    begin[cuts] = is_letter[cuts]
    before, after = padded[:-2].copy(), padded[2:].copy()
    before[cuts] = 0
    after[cuts - 1] = 0
    own = np.flatnonzero(is_letter)
    key = before[own] << U(42) | padded[1:-1][own] << U(21) | after[own]
    bucket = (mix(key) >> U(48)).astype(np.int64)
    begins = np.flatnonzero(begin)
    starts = np.searchsorted(own, begins)
    lengths = np.diff(np.append(starts, len(own)))
    first = np.searchsorted(begins, at)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(bucket, script_of[points[begins]], starts, lengths, begins - at[text_of], first)


@dataclass
class Model:
    """Log probabilities of trigrams by language, and which languages use a script."""

    langs: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): what a task counts; the first BUCKETS cells are trigrams, the rest are letters by script."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "t"):
            w = split_words(part.column("t"))
            langs, code = np.unique(np.asarray(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            word_lang = np.repeat(code, np.diff(w.first))
            # Only the cells that are there, since a slice may have a text of every language.
            cells, n = np.unique(np.repeat(word_lang, w.lengths) * BUCKETS + w.bucket, return_counts=True)
            used = np.bincount(word_lang * N_SCRIPTS + w.script, w.lengths, len(langs) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
            cuts = np.searchsorted(cells, np.arange(len(langs) + 1) * BUCKETS)
            for i, lang in enumerate(langs):
                own = sums.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                own[cells[cuts[i] : cuts[i + 1]] - i * BUCKETS] += n[cuts[i] : cuts[i + 1]]
                own[BUCKETS:] += used[i].astype(np.int64)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "cell", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, log_p, uses) as binary, from a row with all cells of each language."""
    for batch in batches:
        for k in range(batch.num_rows):
            sums = np.zeros(BUCKETS + N_SCRIPTS)
            found = batch.column("cells")[k].values
            sums[found.field("cell").to_numpy()] = found.field("n").to_numpy()
            grams, scripts = sums[:BUCKETS] + ALPHA, sums[BUCKETS:]
            log_p, uses = np.log(grams / grams.sum()).astype(np.float32), scripts >= SCRIPT_SHARE * max(scripts.sum(), 1)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(k, 1), pa.array([log_p.tobytes()], pa.binary()), pa.array([uses.tobytes()], pa.binary())], ["lang", "log_p", "uses"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts all trigrams of all rows with a lang. The counts are summed by Spark, and a language's numbers are made of them by a task; the driver gets BUCKETS numbers of 4 bytes
    for each language, and refuses more than MOST_LANGUAGES of them: such a column holds no languages. Without rows with a lang the
    model has none. Rows without text or lang teach nothing, repeated ones teach again; other columns don't matter."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")
    if (distinct := rows.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{distinct} values of {lang_col}, more than {MOST_LANGUAGES}")
    counts = rows.mapInArrow(_summed, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    found = whole.mapInArrow(_packed, "lang string, log_p binary, uses binary").toArrow().sort_by("lang")
    langs = found["lang"].to_pylist()
    log_p, uses = np.empty((BUCKETS, len(langs)), np.float32), np.empty((N_SCRIPTS, len(langs)), bool)
    for k in range(len(langs)):
        log_p[:, k] = np.frombuffer(found["log_p"][k].as_buffer(), np.float32)
        uses[:, k] = np.frombuffer(found["uses"][k].as_buffer(), bool)
    return Model(langs, log_p, uses)


def scores(w: Words, model: Model) -> np.ndarray:
    """Of each word for each language, relative to the best: 0 or less. Languages that don't use a word's script are out,
    unless none does; such a word is equal for all."""
    s = np.zeros((len(w.starts), len(model.langs)), np.float32)
    if not len(w.starts) or not model.langs:
        return s
    # Words by their first letters, so many that their letters' numbers are CELLS at most, or one word.
    step, at = max(1, CELLS // len(model.langs)), 0
    while at < len(w.starts):
        to = max(at + 1, int(np.searchsorted(w.starts, w.starts[at] + step)))
        low, high = w.starts[at], w.starts[to] if to < len(w.starts) else len(w.bucket)
        s[at:to] = np.add.reduceat(model.log_p[w.bucket[low:high]], w.starts[at:to] - low, axis=0)
        at = to
    s[~model.uses[w.script]] = -1e30
    s -= s.max(axis=1, keepdims=True)
    s[~model.uses[w.script].any(axis=1)] = 0
    return s


def group_bytes(model: Model) -> int:
    return max(1, GROUP_BYTES * FEW // max(FEW, len(model.langs)))


def viterbi(emit: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, all texts step by step together; the longest texts go first, so those
    with a word left are a prefix."""
    n_words, n_langs = emit.shape
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than t words
    stays, best_of = np.ones((n_words, n_langs), bool), np.zeros(n_words, np.int16)
    score = np.zeros((len(lengths), n_langs), np.float32)
    for t in range(longest):
        m = active[t]
        at, s = starts[:m] + t, score[:m]
        if t:
            top = s.argmax(axis=1)
            floor = s[np.arange(m), top][:, None] - penalty
            stays[at] = s >= floor
            best_of[at] = top
            np.maximum(s, floor, out=s)
        s += emit[at]
    label = np.zeros(n_words, np.int64)
    now = score.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        label[at] = now[:m]
        now[:m] = np.where(stays[at, now[:m]], now[:m], best_of[at])
    return label


def decode(texts: Iterable[pa.Array], model: Model, penalty: float) -> tuple[Words, np.ndarray]:
    """Words of some arrays of texts and their labels. Letters are let go array by array, as soon as their words have
    scores; so what a group holds at once are its words, not its letters."""
    parts, emit, words = [], [], 0
    for array in texts:
        w = split_words(array)
        emit.append(scores(w, model))
        parts.append((w.script, w.lengths, w.begins, w.first[:-1] + words))
        words += len(w.starts)
    script, lengths, begins, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(0, np.int64)
    w = Words(none, script, none, lengths, begins, np.append(first, words))
    return w, viterbi(np.concatenate(emit), w.first, penalty) if model.langs else np.zeros(words, np.int64)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans, spans) for each row of docs; a narrow map without shuffle.

    lang_pred is the language of most letters and score its share of all; letters of a script that no language uses
    count for none. Spans are (start, end, lang) in code points,
    from a span's first word to the end of its last one; `spans=False` leaves them null. Null texts and texts without letters
    are `und` with score 0 and no spans, as are all texts if the model has no language. Ties go to the language whose
    name sorts first. Repeated rows are labelled each, a null id gives a null one; other columns don't matter, whatever their names. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        m = shared.value
        w, labels = decode((b.column("t") for b in group), m, penalty)
        n = len(m.langs)
        count = len(w.first) - 1
        ids = pa.concat_arrays([b.column("doc_id") for b in group])
        if not n:
            return pa.RecordBatch.from_arrays([ids, pa.array([UNKNOWN] * count), pa.array(np.zeros(count)), pa.array(np.zeros(count, np.int64)), pa.nulls(count, span_type)], schema=out_type)
        text_of = np.repeat(np.arange(count), np.diff(w.first))
        letters = np.bincount(text_of * n + labels, w.lengths * m.uses[w.script].any(axis=1), count * n).reshape(count, n)
        best, total = letters.argmax(axis=1), np.bincount(text_of, w.lengths, count)
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        pred = names[np.where(total > 0, best, n)]
        share = letters[np.arange(count), best] / np.maximum(total, 1)
        change = np.flatnonzero(np.diff(text_of * n + labels, prepend=-1))
        cuts = np.searchsorted(change, w.first)
        found = pa.nulls(count, span_type)
        if spans:
            ends = (np.append(change[1:], len(labels)) - 1)[: len(change)]
            items = pa.StructArray.from_arrays([pa.array(w.begins[change]), pa.array(w.begins[ends] + w.lengths[ends]), pa.array(names[labels[change]], pa.string())], fields=list(span_type.value_type))
            found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)
        return pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(share), pa.array(np.diff(cuts)), found.cast(span_type)], schema=out_type)

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    out_type = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64()), ("spans", span_type)])

    most = group_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for part in slices(batch, "t"):
                group.append(part)
                size += part.column("t").nbytes
                if size >= most:
                    yield label(group)
                    group, size = [], 0
        if group:
            yield label(group)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long, spans array<struct<start:long,end:long,lang:string>>")


def with_unknown(model: Model) -> Model:
    """model with one more language, the last: of all scripts, all trigrams equally likely. What no language explains better than that is in it, in letters that languages use too."""
    log_p = np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32)
    return Model([*model.langs, UNKNOWN], np.hstack([model.log_p, log_p]), np.hstack([model.uses, np.ones((N_SCRIPTS, 1), bool)]))


def known_languages(docs: DataFrame, model: Model, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of whose letters at least the share `least` is in languages that the model knows, all of them together.

    A language has to explain the words, not their script alone: with_unknown() is what they are held against. Works on the rows where they are: texts are not shuffled to be joined with
    what was found about them. A model without languages rejects nothing: all rows stay. Null texts and texts without letters go; repeated rows stay or go together, and ids are not looked at.
    """
    if not model.langs:
        return docs
    shared, schema, unknown = docs.sparkSession.sparkContext.broadcast(with_unknown(model)), docs.schema, len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, group_bytes(shared.value)):
                w, labels = decode((x.column(text_col) for x in slices(part, text_col)), shared.value, SWITCH)
                if not len(labels):
                    continue
                count = part.num_rows
                text_of = np.repeat(np.arange(count), np.diff(w.first))
                share = np.bincount(text_of, w.lengths * (labels < unknown), count) / np.maximum(np.bincount(text_of, w.lengths, count), 1)
                yield part.filter(pa.array((share >= least) & (share > 0)))

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training. A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model, spans=False).drop("spans")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
