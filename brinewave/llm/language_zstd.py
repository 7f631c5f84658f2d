"""Language identification by compression: the dictionary that shortens a text most names its language.

For each language of the labelled rows a raw-content dictionary is cut from a bounded sample
of its texts: at most ``docs_per_language`` different ones, an equal share of each, up to
``dictionary_bytes``. They are chosen by a hash of key and text, at most twice that number of rows a
language reach the driver, and neither null nor repeated keys nor repeated rows change that. A text is encoded whole, in pieces, with every language's dictionary;
the sums of the encoded sizes decide. The score is the weight of the best language when
each is weighed by exp(-``steepness`` x its excess size relative to the best); a text whose
runner-up comes within ``margin`` of the best, relatively, is ``rejected``: the operator's
``language`` is then ``und``, while ``best`` still names the nearest dictionary.

Dictionaries are broadcast: languages x ``dictionary_bytes``, with ``max_languages`` as the
bound (more are an error, not a cut). Scoring is one pass without a shuffle.

Null texts and texts without a letter are ``und`` with score 0. Equal sizes go to the
language that sorts first. Rows with a null label or text do not train. If nothing trains,
all rows are ``und``. Empty tables give no rows; repeated rows each get one. Extra columns
are ignored, and label and key are never read for a prediction.
"""

from __future__ import annotations

import numpy as np
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import map_texts, stored

PIECE = 1 << 15
UNDECIDED = "und"
_LETTER = regex.compile(r"\p{L}")


#: ASCII that is no letter becomes a blank
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-cased UTF-8 with one blank for each run of other ASCII than letters."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def cut_dictionary(texts: list[str], size: int) -> bytes:
    """An equal share of each text, from its middle, together at most ``size`` bytes."""
    texts = sorted(set(texts))
    share = max(1, size // max(1, len(texts)))
    out = bytearray()
    for text in texts:
        raw = plain(text)
        at = max(0, (len(raw) - share) // 2)
        out += raw[at:at + share]
    return bytes(out[:size])


def train_dictionaries(docs: DataFrame, training: Column, text: str = "text", label: str = "lang", key: str = "doc_id",
                       docs_per_language: int = 300, dictionary_bytes: int = 1 << 15, max_languages: int = 256,
                       seed: int = 5) -> dict[str, bytes]:
    """Dictionary of each language, from a hash-chosen sample of the rows where ``training`` holds."""
    labelled = docs.where(training & F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"),
                           F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("mark"))
    # of each language the smallest hash in each of a fixed number of slots: plain minima, so at most languages x slots rows
    slot = F.pmod("mark", F.lit(2 * docs_per_language))
    least = stored(rows.groupBy("label", slot.alias("slot")).agg(F.min("mark").alias("mark")), "language-picks")
    names = least.select("label").distinct().limit(max_languages + 1).count()
    if names > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    share = 2 * dictionary_bytes // max(1, docs_per_language) * 4
    middle = F.greatest(F.lit(1), ((F.length("text") - share) / 2).cast("int") + 1)
    picked = rows.join(F.broadcast(least.select("label", "mark")), ["label", "mark"], "left_semi").select(
        "label", "mark", F.substring("text", middle, F.lit(share)).alias("text")).groupBy("label", "mark").agg(F.min("text").alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.toLocalIterator():
        texts.setdefault(r["label"], []).append((r["mark"], r["text"]))
    return {name: cut_dictionary([t for _, t in sorted(found)[:docs_per_language]], dictionary_bytes) for name, found in sorted(texts.items())}


class Encoders:
    """Compressors by language, built where they are used."""

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.names = sorted(dictionaries)
        self.encoders = []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(dictionaries[name] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=known, level=level, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = plain(text)
        out = np.zeros(len(self.encoders))
        for at in range(0, len(raw), PIECE):
            piece = raw[at:at + PIECE]
            out += [len(e.compress(piece)) for e in self.encoders]
        return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keys: list[str] = ["doc_id"], text: str = "text", level: int = 5,
             margin: float = 0.01, steepness: float = 40.0) -> DataFrame:
    """(keys, language, best, score, rejected) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(texts: list[str]) -> dict[str, list]:
        encoders = _encoders(shared.value, level)
        language, best, score, rejected = [], [], [], []
        for value in texts:
            if not encoders.names or not _LETTER.search(value):
                language.append(UNDECIDED), best.append(UNDECIDED), score.append(0.0), rejected.append(True)
                continue
            sizes = encoders.sizes(value)
            excess = (sizes - sizes.min()) / sizes.min()
            at = int(sizes.argmin())
            narrow = len(sizes) > 1 and float(np.partition(excess, 1)[1]) < margin
            best.append(encoders.names[at])
            language.append(UNDECIDED if narrow else encoders.names[at])
            score.append(float(1 / np.exp(-steepness * excess).sum()))
            rejected.append(narrow)
        return {"language": language, "best": best, "score": score, "rejected": rejected}

    return map_texts(docs, keys, "language string, best string, score double, rejected boolean", work, text)


_BUILT: dict[tuple, Encoders] = {}


def _encoders(dictionaries: dict[str, bytes], level: int) -> Encoders:
    mark = (level, tuple(sorted((n, hash(d)) for n, d in dictionaries.items())))
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Encoders(dictionaries, level)
    return _BUILT[mark]
