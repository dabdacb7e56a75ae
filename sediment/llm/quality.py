"""Quality rules by tokeniser fertility.

A public vocabulary measures each document: characters per token, the share of tokens that fall back to
bytes, and the entropy of its tokens. A document goes when a measure leaves its language's band; a language
without a band of its own takes the band of the script most of its letters are in. Bands of languages are
quantiles of all labelled good documents, widened by a margin; measures are counted by DECIMALS decimals, so
that a group holds a bounded number of values however many its labels. The band of a script spans the
quantiles of every language labelled in it, so that a language with few labels isn't measured by a larger one
alone; only a script with hardly a label has a fixed band. Entropy is bounded by the logarithm of the token
count, so its floor goes by length: one for each doubling of the tokens.

A null text counts as empty; an empty or very short text fails the base rule (under 50 words) and is not
kept; a null language goes by script; repeated rows are judged alike; a very long text is measured whole, up
to 2^31 different words; an empty table gives an empty result; extra columns pass through keep_good and are
left aside elsewhere, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import Slices, documents, fresh, materialize, remembered, small_batches, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled good documents that a language, or a script over all its languages, needs for a band of its own.
MIN_LABELLED = 50
#: Share of good labelled documents left out at either end, and the margin by which a band is widened.
TAIL, MARGIN = 0.001, 0.005
#: Decimals of the measures that quantiles are taken of; the margin is far wider.
DECIMALS = 4
#: Length classes, by the bits of the token count; the last takes all longer texts.
LENGTHS = 40
REMEMBERED = 300_000

#: (least characters per token, most, most byte fallback, least entropy in bits) of scripts without labels.
SCRIPT_BANDS = {
    "latin": (1.2, 8.0, 0.2, 4.0),
    "cyrillic": (1.0, 6.0, 0.3, 4.0),
    "greek": (0.6, 6.0, 0.6, 3.5),
    "hebrew": (0.5, 6.0, 0.7, 3.5),
    "arabic": (0.5, 6.0, 0.7, 3.5),
    "devanagari": (0.3, 6.0, 0.95, 3.0),
    "han": (0.3, 4.0, 0.95, 3.5),
    "kana": (0.3, 4.0, 0.95, 3.5),
    "hangul": (0.3, 4.0, 0.95, 3.5),
    "other": (0.2, 8.0, 1.0, 3.0),
}
#: First and last letter of the ranges that tell a script.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0xAC00, 0xD7AF),),
}
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
MEASURES = ("chars_per_token", "byte_share", "entropy")
MEASURE_SCHEMA = ", ".join([*(f"{n} long" for n in COUNTS), *(f"{n} double" for n in MEASURES), "script string"])


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    best, most = "other", 0
    for name, ranges in SCRIPT_RANGES.items():
        n = sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges)
        if n > most:
            best, most = name, n
    return best


def repeat_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(numbers)
    if n < 4:
        return 0
    if numbers.max() >> 21 == 0:
        windows = (numbers[:-2] << np.int64(42)) | (numbers[1:-1] << np.int64(21)) | numbers[2:]
    else:  # three numbers don't fit into 64 bits: the pairs are numbered first
        pairs = np.unique(numbers[:-2] << np.int64(32) | numbers[1:-1], return_inverse=True)[1]
        windows = pairs << np.int64(32) | numbers[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = np.zeros(n - 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    hit = np.zeros(n - 2, bool)
    hit[order] = same[1:] | same[:-1]
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def dup_lines(body: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


class Meter:
    """Measures texts by a sentencepiece vocabulary; each distinct word is cut once and remembered."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.cut = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.cut.get_piece_size()
        self.fallback = np.fromiter((self.cut.is_byte(i) for i in range(size)), bool, size)
        self.words = Slices(REMEMBERED)

    def learn(self) -> None:
        ids = self.cut.encode([w.decode() for w in self.words.fresh()], num_threads=1)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.words.add(np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum())), lens)

    def measure(self, texts: list[str]) -> list[tuple]:
        self.words.renew()
        bodies = [t.encode() for t in texts]
        numbers = [self.words.table.numbers(b.split()) for b in bodies]
        if self.words.table.fresh:
            self.learn()
        if numbers:
            self.words.noted(np.concatenate(numbers))
        out = []
        for text, body, at in zip(texts, bodies, numbers, strict=True):
            ids = self.words.of(at)
            word_chars = len(text) - sum(body.count(bytes([b])) for b in BLANKS)
            if len(ids):
                counts = np.bincount(ids)
                share = counts[counts > 0] / len(ids)
                entropy = float(-(share * np.log2(share)).sum())
                measures = (word_chars / len(ids), float(self.fallback[ids].mean()), entropy)
            else:
                measures = (0.0, 0.0, 0.0)
            symbols = sum(body.count(bytes([b])) for b in SYMBOLS)
            out.append((len(at), word_chars, symbols, dup_lines(body), repeat_words(at), len(ids), *measures))
        return out


def band_of(bands: dict | None, language: str | None, script: str) -> tuple:
    """The band of the language, else the fitted band of the script (under the key ("script", its name)), else the fixed one."""
    bands = bands or {}
    return bands.get(language) or bands.get(("script", script)) or SCRIPT_BANDS[script]


def within(band: tuple, n_tokens: int, cpt: float, fall: float, entropy: float) -> bool:
    """The last of a band is the least entropy, one for all lengths or one by the bits of the token count."""
    floor = band[3][min(n_tokens.bit_length(), LENGTHS - 1)] if isinstance(band[3], tuple) else band[3]
    return band[0] <= cpt <= band[1] and fall <= band[2] and entropy >= floor


def _measured(df: DataFrame, model: str, bands: dict | None, text: str, lang: str | None, keep: list[str], only_kept: bool = False) -> DataFrame:
    """One pass over df: the columns `keep`, then the measures, base_failed and kept; or only the kept rows' `keep`."""
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{n}`") for n in keep], text_or_empty(f"`{text}`").alias(fresh("__text", keep)), (F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")).alias(fresh("__lang", keep)))
    kept_schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    extra = [] if only_kept else [MEASURE_SCHEMA, "base_failed boolean, kept boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = remembered(Meter, model)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, langs = part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()
                rows, verdicts, failed, scripts = gauge.measure(texts), [], [], []
                for t, language, row in zip(texts, langs, rows, strict=True):
                    n_words, repeats = row[0], row[4]
                    failed.append(n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words)
                    scripts.append(script_of(t))
                    verdicts.append(not failed[-1] and within(band_of(bands, language, scripts[-1]), *row[5:]))
                columns = [part.column(k) for k in range(len(keep))]
                if only_kept:
                    yield pa.RecordBatch.from_arrays(columns, names=keep).filter(pa.array(verdicts, pa.bool_()))
                    continue
                for k in range(len(COUNTS)):
                    columns.append(pa.array([r[k] for r in rows], pa.int64()))
                for k in range(len(COUNTS), len(COUNTS) + len(MEASURES)):
                    columns.append(pa.array([r[k] for r in rows], pa.float64()))
                columns += [pa.array(scripts, pa.string()), pa.array(failed, pa.bool_()), pa.array(verdicts, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS, *MEASURES, "script", "base_failed", "kept"])

    return source.mapInArrow(run, ", ".join([*kept_schema, *extra]))


def fit_bands(docs: DataFrame, labels: DataFrame, model: str) -> dict:
    """Bands by language and by ("script", name) from all labelled good documents."""
    return bands_of(_measured(docs, model, None, "text", "lang", ["doc_id", "lang"]), labels)


def bands_of(measured: DataFrame, labels: DataFrame) -> dict:
    """Bands from measured documents (doc_id, lang, measures): their few columns meet the labels, no text does."""
    good = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1)).select("doc_id").distinct()
    size = F.length(F.bin("n_tokens")).alias("length")
    rows = measured.where("not base_failed").select("doc_id", F.col("lang").cast("string").alias("lang"), "script", size, *MEASURES).join(good, "doc_id", "left_semi")
    ends = [TAIL, 1 - TAIL]
    tails = [F.percentile(F.round(m, DECIMALS), F.array(*map(F.lit, ends))).alias(m) for m in MEASURES]
    # a row a language, a row a language and script, and each of these by length
    found = rows.groupingSets([["lang"], ["lang", "script"], ["lang", "length"], ["lang", "script", "length"]], "lang", "script", "length")
    found = found.agg(F.grouping("script").alias("whole"), F.grouping("length").alias("all"), F.count("*").alias("n"), *tails).collect()
    by_length: dict[tuple, list] = {}
    for r in found:
        if not r["all"]:
            by_length.setdefault((r["whole"], r["lang"], r["script"]), []).append(r)
    groups = [(r, by_length[r["whole"], r["lang"], r["script"]]) for r in found if r["all"]]
    bands = {r["lang"]: widened([(r, lengths)]) for r, lengths in groups if r["whole"] and r["lang"] is not None and r["n"] >= MIN_LABELLED}
    for script in SCRIPT_BANDS:
        own = [g for g in groups if not g[0]["whole"] and g[0]["script"] == script]
        if sum(r["n"] for r, _ in own) >= MIN_LABELLED:
            bands["script", script] = widened(own)
    return bands


def floors(whole, lengths: list) -> list[float]:
    """The least entropy by length class, from a group's tails over all lengths and by length.

    A class with few labels takes the floor of the next shorter one that has enough; below all of these a bit
    less for each class, as half a text has at most a bit less than the whole; never more than its own tail.
    """
    own = {min(r["length"], LENGTHS - 1): r["entropy"][0] for r in sorted(lengths, key=lambda r: -r["length"])}
    known = {min(r["length"], LENGTHS - 1): r["entropy"][0] for r in lengths if r["n"] >= MIN_LABELLED} or {min(own): whole["entropy"][0]}
    least, out = min(known), []
    for c in range(LENGTHS):
        at = max((k for k in known if k <= c), default=least)
        out.append(min(known[at] - max(0, at - c), own.get(c, np.inf)))
    return out


def widened(groups: list) -> tuple:
    """The band that spans the tails of several groups, with its margin."""
    low = lambda m: min(r[m][0] for r, _ in groups)
    high = lambda m: max(r[m][1] for r, _ in groups)
    entropy = tuple(float(f) * (1 - MARGIN) for f in np.min([floors(*g) for g in groups], axis=0))
    return (low("chars_per_token") * (1 - MARGIN), high("chars_per_token") * (1 + MARGIN), high("byte_share") + MARGIN, entropy)


def fertility(docs: DataFrame, model: str, bands: dict[str, tuple] | None = None, text: str = "text", lang: str | None = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the counts and measures, script, base_failed, kept."""
    return _measured(docs, model, bands, text, lang, list(keep))


def keep_good(docs: DataFrame, model: str, bands: dict[str, tuple] | None = None, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of docs that pass given bands, with all their columns."""
    return _measured(docs, model, bands, text, lang, docs.columns, only_kept=True)


def fit_and_keep(docs: DataFrame, labels: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that pass the bands of their own labelled documents, with all their columns.

    The texts are measured once: rows are written out with their measures, the bands come from the measures
    alone, and the rows are read again.
    """
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    packed = docs.select(whole, F.col(f"`{key}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t"))
    measured = materialize(_measured(packed, model, None, "t", "lang", ["row", "doc_id", "lang"]))
    return judged(measured, bands_of(measured, labels)).where("kept").select("row.*")


def production_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def judged(measured: DataFrame, bands: dict) -> DataFrame:
    """Measured documents (with lang) under other bands: kept anew, without measuring again."""

    @F.arrow_udf("boolean")
    def kept(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([not failed and within(band_of(bands, language, script), *row) for failed, language, script, *row in rows], pa.bool_())

    return measured.withColumn("kept", kept("base_failed", F.col("lang").cast("string"), "script", "n_tokens", *MEASURES))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read twice below: the texts are measured once
    measured = materialize(fertility(documents(spark, sf_dir), production_model(), keep=("doc_id", "lang")))
    out = judged(measured, bands_of(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *MEASURES, "script")
