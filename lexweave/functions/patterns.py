"""Token patterns and punctuation.

Fixed values: these decide which strings are tokens, so they must not drift.  ``\\d`` and
``\\S`` are spelt out as Unicode classes because the regex engines differ on them.
"""

# letters, with punctuation allowed inside a word
WORD = r"\p{L}+[\p{P}\p{L}]+\p{L}|\p{L}+"
# letters and digits, with punctuation allowed inside
WORD_DIGITS = r"[\p{L}\p{Nd}]+[\p{P}\p{L}\p{Nd}]+[\p{L}\p{Nd}]|[\p{L}\p{Nd}]+"
# as above, and every other punctuation mark is a token of its own
KEEP_PUNCT = r"[\p{L}\p{Nd}]+[\p{P}\p{L}\p{Nd}]+[\p{L}\p{Nd}]|[\p{L}\p{Nd}]+|\p{P}"
# three or more characters, the topic trainer's default
LETTERS_PUNCT = r"\p{L}[\p{L}\p{P}]+\p{L}"
# anything between white space
NON_SPACE = r"[^\x09-\x0d\x85\p{Z}]+"
# anything between separators, used when importing treated text
NON_SEPARATOR = r"[^\p{Z}]+"

# removed punctuation; the hyphen stays because of compounds
PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~₽«»–"

# white space as str.isspace understands it, without the line feed
BLANK = r"[\x09\x0b-\x0d\x1c-\x20\x85\p{Z}]"

TOKEN_PATTERNS = {
    "word": WORD,
    "word_digits": WORD_DIGITS,
    "keep_punct": KEEP_PUNCT,
    "letters_punct": LETTERS_PUNCT,
    "non_space": NON_SPACE,
    "non_separator": NON_SEPARATOR,
}
