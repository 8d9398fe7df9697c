"""Extraction patterns and their rendering for the JVM regex engine."""

from __future__ import annotations

# Extraction patterns.
MONEY = (r"(?:USD|US\$|\$|₹|INR|\bRs\.?|€|£)\s?[\d,]+(?:\.\d+)?(?:\s?(?:million|billion|thousand|lakh|crore))?"
         r"|\b\d+(?:\.\d+)?\s?%")
DATE = (r"\b(?:\d{1,2}(?:st|nd|rd|th)?\s+day\s+of\s+)?"
        r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
        r"\s+\d{1,2},?\s+\d{4}|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b")
DURATION = r"\b(\d+)\s?(day|days|month|months|year|years|week|weeks)\b"
SECTION_REF = r"\b(?:Section|Clause|Article|Paragraph)\s+\d+(?:\.\d+)*"
OBLIGATION = (r"\b([A-Z][A-Za-z&,.]{2,40})\s+(shall(?:\s+not)?|must(?:\s+not)?|will(?:\s+not)?|agrees to)"
              r"\s+([^.\n]{3,80})")
MODAL_MENTION = (r"\b([A-Z][A-Za-z&,.]{2,40})\s+((?:shall|must|will|may|might|could|should)(?:\s+not)?)"
                 r"\s+([^.\n]{3,80})")
CLAUSE_NUMBER = r"\b(?:Section|Clause|Article|Paragraph)\s+(\d+(?:\.\d+)*)\b"
LEADING_NUMBER = r"^\s*(\d+(?:\.\d+)*)\s*[\.\):]?\s*"
TITLE_PREFIX = r"^(section|clause|article|paragraph)\s+\d+(?:\.\d+)*\s*[\.:\)]?\s*"
LABELLED_NUMBER = (
    r"\b(penalty|late fee|interest(?:\s+rate)?|security deposit|deposit|discount|commission|royalty|rent|"
    r"liability cap|cap on liability|notice period|cure period|grace period|annual fee|service fee|"
    r"subscription fee|management fee|processing fee)\b[^.\n%$]{0,25}?"
    r"(\d+(?:\.\d+)?\s?%|(?:USD|US\$|\$|₹|INR|Rs\.?|€|£)\s?[\d,]+(?:\.\d+)?)")
NUMBER_TOKEN = r"\d+(?:[.,]\d+)*%?"
PARTY = r"([A-Z][A-Za-z0-9&.,\- ]{2,60}?)\s*\(\s*[\"“]([^\"”]{2,40})[\"”]\s*\)"
JURISDICTION = (r"(?:governing law|governed by the laws of|state of|courts of)\s+(?:the\s+)?"
                r"([A-Z][A-Za-z ]{2,30})")
PENALTY = r"\b(penalty|liquidated damages|late fee)\b[^.\n]{0,60}"
STATE = r"state of ([a-z]+(?:\s[a-z]+){0,2})"
CID = r"(?:\(cid:\d+\))+"
BLANK_LINES = r"\n\s*\n+"
NUMBERED_MARKER = r"\n(?=\s*(?:\d+(?:\.\d+)*[\.\)]\s+|\(\d+\)\s+))"
LETTERED_MARKER = r"\n(?=\s*(?:[A-Za-z][\.\)]\s+|\([A-Za-z]\)\s+))"
BULLET_MARKER = r"\n(?=\s*[•▪◦‣·\-\*]\s+\S)"
HEADING_NUMBERED = r"^(?:section|clause|article|part)\s+\d+(?:\.\d+)*[:\-\s\.]|^\d+\.\s+[A-Z]"
HEADING_ROMAN = r"^(?:article\s+)?[IVXLCDM]{1,6}\.?\s*[-:.]?\s*[A-Z]"
HEADING_CAPS = r"^[A-Z][A-Z0-9 &,\-]{2,59}$"
HEADING_TITLE = r"^[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*){0,5}$"
PLACEHOLDER_VALUE = r"^[\s\-_.:]*$|^(n/?a|tbd|none|pending|to be (?:filled|determined|confirmed))[\s.]*$"
CURRENCY_TOKEN = r"\b(?:rs|inr|usd|eur|gbp)\b\.?|[₹$€£%]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
URL = r"\b(?<![\w/.])(?:(?:https?|ftp)://)?(?:(?:[\w-]+\.)+(?!\.))(?:[\w/\-?#&=%.]+)+(?!\.\w+)\b"
NUMERAL = (r"(~?\d+\.?\d*\s?%?\s?-?\s?~?\d+\.?\d*\s?%|~?\d+%|\d+[-\/.,:']\d+[-\/.,:'+]\d+(?:\.\d+)?"
           r"|\d+[-\/.:'+]\d+(?:\.\d+)?)")
HANDLE = r"[A-Za-z0-9]*[#|@]\w+"


def jvm(pattern: str, ignore_case: bool = False) -> str:
    """Unicode-aware form of a pattern, as the expected results need."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


#: Characters that can begin a match of a pattern in a text of ASCII characters.
#: (Characters are written out, since the engine looks a list of them up in one table, but tests a range or class apart.)
DIGITS, CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BEGINS = {MONEY: DIGITS + "UIR$", DATE: DIGITS + "JFMASOND", DURATION: DIGITS, SECTION_REF: "SCAP", OBLIGATION: CAPITALS, MODAL_MENTION: CAPITALS,
          CLAUSE_NUMBER: "SCAP", LABELLED_NUMBER: "plisdcrngam", NUMBER_TOKEN: DIGITS, PARTY: CAPITALS, JURISDICTION: "gsc", PENALTY: "pl", STATE: "s"}


def plain(pattern: str, ignore_case: bool = False) -> str:
    """Form of a pattern for texts of ASCII characters only, where it finds what the Unicode-aware form finds.

    There words, digits and blanks are the same in both; places where no match can begin are passed over at once.
    """
    body = f"(?=[{BEGINS[pattern]}])(?:{pattern})" if pattern in BEGINS else pattern
    return ("(?i)" if ignore_case else "") + body


def literal(text: str) -> str:
    """A pattern that matches just this text."""
    specials = set(r"\.^$|?*+()[]{}-&#")
    return "".join("\\" + c if c in specials else c for c in text)


def word(keyword: str) -> str:
    """Whole-word pattern of a literal keyword."""
    return r"\b" + literal(keyword) + r"\b"
