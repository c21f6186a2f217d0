"""Token counts with the whole-token shortcut.

No piece of the vocabulary has a blank after another character, so merges never cross from a word to the blank before
the next one: a text's tokens are those of its words, each with its leading blank. Once per process the vocabulary is
gone through offline, and every piece that the library encodes alone as exactly one token is noted. A word that is such
a piece counts as one; the library merges only the rest, whose counts are kept in a bounded cache.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import annotate

LIMIT = 4096
BLANK = "▁"
#: Words kept in the cache at most, and the characters of the longest one kept: some 50 MB.
_CACHE, _LONGEST = 300_000, 32
_WORD = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Tokens of texts as the library counts them."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        ordinary = [p for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.separable = not any(BLANK in p.lstrip(BLANK) for p in ordinary)
        #: words (without their leading blank) proved to be one token
        words = [p[1:] for p in ordinary if p.startswith(BLANK) and len(p) > 1 and BLANK not in p[1:]]
        self.whole = {w for w, ids in zip(words, self.library.encode(words, num_threads=1)) if len(ids) == 1}
        #: tokens of the single blank that ends a text, which the library doesn't encode alone
        self.blank = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.rest: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable or BLANK in text:
            return len(self.library.encode(text, num_threads=1))
        if text[0] == " " or text[-1] == " " or "  " in text:
            words = [w[1:] for w in _WORD.findall(" " + text)]  # the blank that the library puts in front of each
        else:
            words = text.split(" ")
        whole, rest, encode = self.whole, self.rest, self.library.encode
        others = [w for w in words if w not in whole]
        n_whole, last = len(words) - len(others), 0
        if others and not others[-1]:  # only the end of the text can give a word that is empty
            others.pop()
            last = self.blank
        if len(rest) > _CACHE:
            rest.clear()
        missing = [w for w in set(others) if w not in rest]
        counts = dict(zip(missing, map(len, encode(missing, num_threads=1)))) if missing else {}
        rest.update((w, n) for w, n in counts.items() if len(w) <= _LONGEST)
        return n_whole + last + sum([rest[w] if w in rest else counts[w] for w in others])


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes and tokens. Repeated rows are counted each; an empty table gives no rows.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        count = counter(model_path).count
        return [pa.array([count(t or "") for t in texts.to_pylist()], pa.int64())]

    n_bytes = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    made = annotate(docs.select("doc_id", "text", n_bytes.alias("n_bytes")), ["text"], [("n_tokens", T.LongType())], make, ["doc_id", "n_bytes"])
    return made.select("row.doc_id", "row.n_bytes", "res.n_tokens", (F.col("res.n_tokens") > limit).alias("over_limit"))
