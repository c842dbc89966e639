"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary, filled from a bounded sample of its labelled documents (about
`sample_docs` of them, picked by hash of doc_id; of each PARTS stretches from its beginning to its end, `share_bytes`
in all, or the whole text if it's shorter). What the sample holds beyond `dictionary_bytes` is left out, which the
defaults seldom reach. The whole text to judge, lower-cased and without ASCII digits and marks, is compressed in blocks
of `block_bytes` with each dictionary, so a long text can't drown the dictionary in its own history. The score is 1 - smallest / second smallest size; where it's under `margin`, the
text is rejected.

Defined results: null texts and texts without letters are `und` with score 0 and rejected; equal sizes go to the
language that sorts first, with score 0; without any labelled document all texts are `und`; documents with a null
doc_id are predicted but not learned from, and not held out; repeated rows each get their row; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.words import slices

UNKNOWN = "und"

#: Lower levels find too few of the short matches that tell languages apart.
LEVEL = 6

#: Stretches of a document that it's learned from, evenly spaced.
PARTS = 3

_ASCII_MARKS = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalpha())


def letters(text: str) -> bytes:
    """Lower case without ASCII digits and marks, which are the same in all languages."""
    return text.lower().encode().translate(None, _ASCII_MARKS)


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = 130, share_bytes: int = 1500, dictionary_bytes: int = 200_000) -> dict[str, bytes]:
    """Each language's dictionary, from rows with doc_id, lang and text. The bounds hold for each language."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    million = 1_000_000
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(-(-sample_docs * million // n)))])
    order = F.xxhash64("doc_id")
    picked = docs.filter(F.pmod(order, F.lit(million)) < share[F.col("lang")]).select("lang", order.alias("at"), F.encode("text", "UTF-8").alias("text"))
    size, each = F.octet_length("text"), share_bytes // PARTS
    stretches = F.concat(*[F.substring("text", F.floor((size - each) * i / (PARTS - 1)).cast("int") + 1, F.lit(each)) for i in range(PARTS)])
    picked = picked.select("lang", "at", F.when(size > share_bytes, stretches).otherwise(F.col("text")).alias("text"))
    held: dict[str, list[bytes]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.at, bytes(r.text))):
        held.setdefault(r.lang, []).append(letters(bytes(r.text).decode("utf-8", "ignore")))
    return {lang: b"\n".join(texts)[-dictionary_bytes:] for lang, texts in held.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], margin: float = 0.002, block_bytes: int = 4096) -> DataFrame:
    """Columns `keep` with lang_pred, score and rejected. The text goes to the workers once, also where it's kept."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # dictionary_bytes for each language at most
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def predict(batches):
        import zstandard

        langs = sorted(shared.value)
        coders = []
        for lang in langs:
            words = zstandard.ZstdCompressionDict(shared.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in slices(batches, name):
            found, scores = [], []
            for text in batch.column(name).to_pylist():
                if not langs or text is None or not any(map(str.isalpha, text)):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                raw = letters(text)
                parts = [raw[at : at + block_bytes] for at in range(0, len(raw), block_bytes)]
                sizes = np.array([sum(len(coder(x)) for x in parts) for coder in coders])
                best = int(sizes.argmin())
                found.append(langs[best])
                scores.append(1 - float(sizes[best]) / float(np.partition(sizes, 1)[1]) if len(sizes) > 1 else 1.0)
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array([w == UNKNOWN or s < margin for w, s in zip(found, scores)], pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    name = "text" if "text" in keep and dict(docs.dtypes)["text"] == "string" else "_text"
    source = docs.select(*keep, *([F.col("text").cast("string").alias(name)] if name != "text" else []))
    return source.mapInArrow(predict, schema)


def language_id(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each document; learned from the documents not held out."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = rows.withColumn("held_out", held_out(fold, folds))
    return identify(out, learn(rows.filter(~held_out(fold, folds))), ["doc_id", "held_out"])
