"""Spoken lines of subtitle files, whatever their format: what the text operators read.

Cues begin at a timing line (with or without a line of a number before it) or at a pair of frame numbers in braces. Formatting tags, sound descriptions
in brackets, note signs, speaker names and lines that are adverts are no speech. A text without any cue is plain text: each line of it with a
letter is one cue, and nothing but markup is taken out of it.
"""

from __future__ import annotations

import re

FRAMES = re.compile(r"[ \t]*\{\d+\}\{\d*\}")
TAG = re.compile(r"<[^<>\n]{0,120}>|\{[^{}\n]{0,120}\}")
SOUND = re.compile(r"\([^()]{0,200}\)|\[[^\[\]]{0,200}\]|\*[^*\n]{0,80}\*")
SPEAKER = re.compile(r"(?m)^[ \t>-]*[A-Z][A-Z0-9.' -]{1,24}:(?=\s)")
ADVERT = re.compile(
    r"\b(?:sub(?:title|titre|titulo)s?\b.*\bby|sync(?:ed|hroni[sz]ed)?\b.*\bby|corrected by|ripped by|encoded by|transl(?:ated|ation) by|downloaded from|download more|"
    r"visit us|www\.|https?:|\w+\.(?:com|org|net|tv|info|example|invalid)\b|advertise your|support us|become (?:a )?vip|watch in hd|dot (?:com|net|org|example)\b)|"
    r"^\s*==.*==\s*$|^\s*~.*~\s*$|\S@\w",
    re.IGNORECASE,
)
#: Of these, in lower case, every advert has one: what looks for adverts looks at few lines.
HINTS = ("by", "www.", "http", "@", ".com", ".org", ".net", ".tv", ".info", ".example", ".invalid", "download", "visit", "advert", "support", "vip", "watch", "dot", "==", "~")
NOTES = re.compile(r"[♪♫#*]+|â™[ª«]")
#: Humming between note signs is a sound.
HUMMING = re.compile(r"(?:\W|\b(?:la|na|da|m+|h+m+|o+h*|a+h+)\b)*", re.IGNORECASE)


def _split(text: str) -> list[str] | None:
    """The bodies of all cues, in order, as they stand; None if there is no cue."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[list[str]] = []
    for line in text.split("\n"):
        if "-->" in line:
            if out and out[-1] and out[-1][-1].strip(" \t").isdigit():
                out[-1].pop()  # the number of the cue that begins here
            out.append([])
        elif line.lstrip(" \t")[:1] == "{" and (frames := FRAMES.match(line)):
            out.append([line[frames.end() :]])
        elif out:
            out[-1].append(line)
    return ["\n".join(b) for b in out] if out else None


def cues(text: str | None) -> list[str]:
    """The bodies of all cues; a text without any is one."""
    return [] if not text else _split(text) or [text]


def spoken(body: str) -> str:
    """What is spoken in a cue; empty if nothing is."""
    if "<" in body or "{" in body:
        body = TAG.sub(" ", body)
    if "(" in body or "[" in body or "*" in body:
        body = SOUND.sub(" ", body)
    if ":" in body:
        body = SPEAKER.sub(" ", body)
    line = NOTES.sub(" ", body).replace("|", " ").strip()
    return "" if HUMMING.fullmatch(line) else line


def is_advert(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS) and ADVERT.search(text) is not None


def spoken_cues(text: str | None) -> list[str]:
    """The spoken text of each cue that has any besides adverts."""
    bodies, out = _split(text) if text else [], []
    if bodies is None:
        lines = (TAG.sub(" ", line).strip() for line in text.splitlines())
        return [line for line in lines if any(c.isalpha() for c in line)]
    for body in bodies:
        line = spoken(body)
        if line and is_advert(line):
            line = "\n".join(x for x in line.split("\n") if not is_advert(x)).strip()
        if line and any(c.isalpha() for c in line):
            out.append(line)
    return out
