"""Character classes and word lists. One spelling of each class serves both Java's regex engine and RE2."""

from __future__ import annotations

# What Python's \s and \w match, as the inside of a class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
# The white space again, character by character.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"

# A place where a word begins or ends.
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

SENTENCE_END = ".!?。！？"

# Fixed values of the cleaning stages.
ZERO_WIDTH = "​‌‍﻿"
DOUBLE_QUOTES = '"`´'
LOW_QUOTE = "‚"
DASHES = "–—−"
URL = r"https?://[!$-_a-z]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
PAGE_MARK = r"--- Page \p{Nd}+ ---\n?"
DISALLOWED = rf"[^{WORD}{WS}.,:;!?()\[\]{{}}\"'\\/-]"

# Separators of the recursive splitter, in order; the last resort is a window of characters.
SEPARATORS = ("\n\n", "\n", ". ", "。 ", "! ", "? ", "; ", ", ", " ")

# What a sentence that goes on with the one before starts with.
CONNECTORS = (
    "tuy nhiên", "nhưng", "và", "vì vậy", "do đó", "bởi vì", "ngoài ra",
    "moreover", "however", "therefore", "furthermore", "additionally",
    "in addition", "consequently", "as a result", "because", "since",
)

# Words that do not count when neighbouring sentences are compared.
GROUPING_STOP_WORDS = (
    "là", "của", "và", "có", "trong", "với", "cho", "về", "từ", "được", "một",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
)

# Words that do not count in sentence features.
FEATURE_STOP_WORDS = (
    "là", "của", "và", "có", "trong", "với", "cho", "về", "từ", "được", "một",
    "này", "đó", "các", "những", "để", "khi", "nếu", "như", "theo", "nhưng",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being",
)

# Letters of a phrase. đ is not among them.
PHRASE_LETTERS = "a-záàảãạăắằẳẵặâấầẩẫậeéèẻẽẹêếềểễệiíìỉĩịoóòỏõọôốồổỗộơớờởỡợuúùủũụưứừửữựyýỳỷỹỵ"

NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
DATE = r"\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}"
NAME = r"[A-Z][a-z]+"
PHRASE = rf"[{PHRASE_LETTERS}]+[{WS}]+[{PHRASE_LETTERS}]+"


def bounded(pattern: str) -> str:
    """The pattern between word edges."""
    return f"{EDGE}{pattern}{EDGE}"


# The same classes and patterns for Java's engine alone, which tries the members of a class one after the other: those
# below U+0100 that are listed one by one are looked up in a table, and the rest is tried for other characters only. A
# pattern's first character is matched before what must not stand before it is looked at, and runs are possessive where
# giving characters back could not lead to a match.
_BEYOND = r"\x{80}-\x{10ffff}"
_ASCII_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
JAVA_WS = rf"[[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0][\x{{1680}}-\x{{3000}}&&[{WS}]]]"
JAVA_WORD = rf"[[{_ASCII_WORD}][{_BEYOND}&&[\p{{L}}\p{{N}}𝒜]]]"  # one letter beyond U+FFFF by itself: without any, Java looks back by UTF-16 units
JAVA_DIGIT = rf"[[0123456789][{_BEYOND}&&[\p{{Nd}}]]]"
JAVA_PHRASE_LETTER = rf"[[abcdefghijklmnopqrstuvwxyz][{_BEYOND}&&[{PHRASE_LETTERS}]]]"
JAVA_EDGE = rf"(?:(?<={JAVA_WORD})(?!{JAVA_WORD})|(?<!{JAVA_WORD})(?={JAVA_WORD}))"
JAVA_EMAIL = rf"{JAVA_EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{JAVA_EDGE}"
JAVA_AFTER_SENTENCE = rf"{JAVA_WS}(?<=[{SENTENCE_END}]{JAVA_WS}){JAVA_WS}*+"
JAVA_NUMBER = rf"{JAVA_DIGIT}(?<!{JAVA_WORD}{JAVA_DIGIT}){JAVA_DIGIT}*(?:[.,]{JAVA_DIGIT}+)*(?!{JAVA_WORD})"
JAVA_DATE = rf"{JAVA_DIGIT}(?<!{JAVA_WORD}{JAVA_DIGIT}){JAVA_DIGIT}?[/-]{JAVA_DIGIT}{{1,2}}[/-]{JAVA_DIGIT}{{2,4}}(?!{JAVA_WORD})"
JAVA_NAME = rf"[A-Z](?<!{JAVA_WORD}[A-Z])[a-z]++(?!{JAVA_WORD})"
JAVA_PHRASE = rf"{JAVA_PHRASE_LETTER}(?<!{JAVA_WORD}{JAVA_PHRASE_LETTER}){JAVA_PHRASE_LETTER}*+{JAVA_WS}++{JAVA_PHRASE_LETTER}++(?!{JAVA_WORD})"
JAVA_SINGLE_LETTER = rf"[A-Za-z](?!{JAVA_WORD})(?<!{JAVA_WORD}[A-Za-z])"
JAVA_DISALLOWED = rf"[^[{_ASCII_WORD}\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0.,:;!?()\[\]{{}}\"'\\/\-][{_BEYOND}&&[\p{{L}}\p{{N}}{WS}]]]"
