"""English suffix stripping after Porter (1980), written from the published rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# The published rules of steps 2, 3 and 4, in their order.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c not in "aeiou" and not (c == "y" and i and out[-1]))
    return out


def _measure(w: str) -> int:
    c = _consonants(w)
    return sum(not a and b for a, b in zip(c, c[1:], strict=False))


def _vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonants(w)[-3:] == [True, False, True] and w[-1] not in "wxy"


def _replace(w: str, rules: str) -> str:
    best = max((r.split(":") for r in rules.split() if w.endswith(r.split(":")[0])), key=lambda r: len(r[0]), default=None)
    if best and _measure(w[: -len(best[0])]) > 0:
        return w[: -len(best[0])] + best[1]
    return w


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and _vowel(w[: -len(x)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2), STEP3)
    best = max((x for x in STEP4.split() if w.endswith(x)), key=len, default=None)
    if best and _measure(w[: -len(best)]) > 1 and (best != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(best)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@arrow_udf(ArrayType(StringType()))
def stem_all(words: pa.Array) -> pa.Array:
    """The stems of each row's tokens; each distinct word of a batch is stemmed once."""
    own = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in own.dictionary.to_pylist()], pa.string()).take(own.indices)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stems, mask=words.is_null())
