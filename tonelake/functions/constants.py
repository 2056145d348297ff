"""Fixed values of the keyed-tone corpus: code table, vocabulary, rates and limits."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 8000
CHUNK_SECONDS = 8.0
PSEUDO_CHUNK_SECONDS = 10.0
MAX_FRAMES, HOP = 2000, 32
MIN_WORDS_ALIGNED, MIN_WORDS_DURATION = 3, 2
MIN_WPM_EPISODE, MIN_WPM_SEQUENTIAL, MIN_WPM_TRAIN = 13.0, 15.0, 13.0
TARGET_WPM, WPM_LOW, WPM_HIGH = 20.0, 3.0, 80.0
GAP_CHAR, GAP_WORD = 3, 7

# The international code, and SOS as one sign.
CODES = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---",
    "K": "-.-", "L": ".-..", "M": "--", "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-",
    "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
    ".": ".-.-.-", ",": "--..--", "?": "..--..", "'": ".----.", "!": "-.-.--", "/": "-..-.", "(": "-.--.", ")": "-.--.-",
    "&": ".-...", ":": "---...", ";": "-.-.-.", "=": "-...-", "+": ".-.-.", "-": "-....-", "_": "..--.-", '"': ".-..-.",
    "$": "...-..-", "@": ".--.-.", "SOS": "...---...",
}

VOCABULARY = ["<blank>", *sorted(CODES), " "]
SIGNS = [c for c in CODES if len(c) == 1]


def units(code: str) -> int:
    """Length of one sign: a dit is 1 unit, a dah 3, and 1 unit stands between them."""
    return sum(1 if s == "." else 3 for s in code) + len(code) - 1


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
