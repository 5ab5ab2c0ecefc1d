"""Text cleaning and context windows.

Each deletion rule is written so that the Java matcher neither recurses nor
rescans: loops are possessive and a run is entered only at its start.  Both
leave the deleted spans as they are with plain greedy loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind
from .fixed_values import CONTEXT_RADIUS
from .regex import DIGIT, SPACE, SPACE_NOT_BLANK, WORD, strip

_HEX = "0-9a-fA-F"
_NOT_AFTER_WORD = f"(?<![{WORD}])"
_NOT_BEFORE_WORD = f"(?![{WORD}])"
_UUID = "[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}"

_RUN = f"[{_HEX}-]"

# What each deletion rule removes, in order.  The two URL rules
# belong to the full set only.
# (name, pattern, literal that every match contains, cheap pattern that is
# found in every text with a match); the last two only save work.
NOISE_RULES = [
    ("quotes", "['\"│]", "", ""),
    ("directory_listing",
     rf"drwx[-{SPACE}]*+[{DIGIT}]+[{SPACE}]+[{WORD}]+[{SPACE}]+[{WORD}]+[{SPACE}]+[{DIGIT}]+[{SPACE}]+[{WORD}]+"
     rf"[{SPACE}]+[{DIGIT}]+[{SPACE}]+{_RUN}+[^\n]*", "drwx", ""),
    ("shell_block", r"(?i)```shell[^`]++```", "```", ""),
    ("quoted_shell_block", rf'(?i)```shell[{SPACE}]*"[^"]*"[{SPACE}]*```', "```", ""),
    ("saved_game", r"<details><summary>Saved game</summary>\n\n```[^\n]*?```", "<details>", ""),
    ("dotted_name", rf"{_NOT_AFTER_WORD}[{WORD}]++(?:\.[{WORD}]++)++", "", rf"\.[{WORD}]"),
    ("stack_frame", rf"at[{SPACE}][{WORD}.$]+\.[{WORD}]+\([^:]++:[{DIGIT}]+\)", "(", ""),
    ("url_with_fragment", rf"(?i)https?://[^{SPACE}#]++#[a-z0-9=+-]++", "://", ""),
    ("url", r"https?://[!$-_a-z]++", "://", ""),
    ("commit_id", rf"(?i)commit ?(?:id)? ?:? ?[0-9a-f]{{40}}{_NOT_BEFORE_WORD}", "", ""),
    ("path_with_blanks", rf"/[{WORD}/. :-]++", "/", ""),
    ("path", rf"(?:/[^/{SPACE}]++)++", "/", ""),
    ("sha256", rf"sha256[{SPACE}]*:?=?[{SPACE}]*[{_HEX}]{{64}}", "sha256", ""),
    ("tree_sha1", rf"git-tree-sha1[{SPACE}]*=[{SPACE}]*[{_HEX}]++", "git-tree-sha1", ""),
    ("build_id", rf"build-id[{SPACE}]*:?=?[{SPACE}]*[{_HEX}]++", "build-id", ""),
    ("guid_triple", rf"GUIDs:[{SPACE}]++{_RUN}++[{SPACE}]++{_RUN}++[{SPACE}]++{_RUN}++", "GUIDs:", ""),
    ("hex_triple", rf"(?<!{_RUN}){_RUN}++[{SPACE}]*+,[{SPACE}]*+{_RUN}++[{SPACE}]*+,[{SPACE}]*+{_RUN}++",
     ",", rf",[{SPACE}]*+{_RUN}++[{SPACE}]*+,"),
    ("angle_brackets", r"<[^>]++>", ">", ""),
    ("prefixed_uuid",
     rf"(?i)(?:uuid|guid|version|id)[\\=:\"'{SPACE}]*{_NOT_AFTER_WORD}{_UUID}{_NOT_BEFORE_WORD}",
     "-", rf"-[{_HEX}]{{4}}-"),
    ("prefixed_pointer", rf"(?i)(?:data|address|id)[\\=:\"'{SPACE}]*{_NOT_AFTER_WORD}0x[0-9a-f]++{_NOT_BEFORE_WORD}",
     "", rf"0[xX][{_HEX}]"),
    ("screenshot",
     rf"(?i)Screenshot_[{DIGIT}]{{4}}(?:[_-][{DIGIT}]{{2}}){{6}}[_-][{WORD}]++", "_", ""),
]
URL_RULES = {"url_with_fragment", "url"}


def normalize_text(text: Column) -> Column:
    """One line of printable ASCII: white space runs become a blank, end-of-text
    marks and all other characters go.  NULL becomes the empty string."""
    # A single blank already is what a run becomes, so only other runs match.
    runs = f" [{SPACE}]++|[{SPACE_NOT_BLANK}][{SPACE}]*+"
    line = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), runs, " ")
    return F.regexp_replace(F.regexp_replace(line, "</s>|<eos>", ""), r"[^\x20-\x7E]++", "")


def _apply(text: Column, rule: tuple[str, str, str, str]) -> Column:
    _, pattern, literal, sign = rule
    if not literal and not sign:
        return F.regexp_replace(text, pattern, "")

    def delete(t: Column) -> Column:
        possible = F.lit(True)
        if literal:
            possible = t.contains(literal)
        if sign:
            possible = possible & t.rlike(sign)
        return F.when(possible, F.regexp_replace(t, pattern, "")).otherwise(t)

    return bind(text, delete)


def _delete(text: Column, rules: list[tuple[str, str, str, str]]) -> Column:
    return reduce(_apply, rules, text)


def strip_noise(text: Column) -> Column:
    """Delete listings, code blocks, stack frames, paths, hashes and ids."""
    return _delete(text, [r for r in NOISE_RULES if r[0] not in URL_RULES])


def strip_noise_and_urls(text: Column) -> Column:
    """:func:`strip_noise` plus both URL rules."""
    return _delete(text, NOISE_RULES)


def clean_for_inference(text: Column) -> Column:
    return strip_noise_and_urls(normalize_text(text))


def clean_if_missing(text: Column, candidate: Column) -> Column:
    """Clean a text only when its candidate does not occur in it."""
    return F.when(F.contains(text, candidate), text).otherwise(strip_noise(text))


def context_window(text: Column, candidate: Column, radius: int = CONTEXT_RADIUS) -> Column:
    """The first occurrence with ``radius`` characters on both sides, or NULL."""

    def cut(at: Column) -> Column:
        start = F.greatest(at - radius, F.lit(1))
        return F.when(at > 0, F.substring(text, start, at + F.length(candidate) + radius - start))

    # The search reads the whole text: once is enough.
    return bind(F.instr(text, candidate), cut)
