"""Plain versions that tests compare with."""

import re

BREAK = re.compile(r"[\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    words = [w for w in BREAK.split(lowered(text)) if w]
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
