"""English function words: a parameter.

In order: the words of the file that QUARRY_STOP_WORDS names (one a line), scikit-learn's list where that is installed,
a frozen list.
"""

import os

FROZEN = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me might more most must my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up us very was we were what when where which while who whom why will with would you your yours".split()
)


def load(path: str | None = None) -> tuple[str, ...]:
    """The words in order, from path or else as above."""
    if path := path or os.environ.get("QUARRY_STOP_WORDS"):
        with open(path, encoding="utf-8") as f:
            return tuple(sorted({w for w in f.read().split() if w}))
    try:
        from sklearn.feature_extraction.text import ENGLISH_STOP_WORDS
    except ImportError:
        return FROZEN
    return tuple(sorted(ENGLISH_STOP_WORDS))


STOP_WORDS = load()
