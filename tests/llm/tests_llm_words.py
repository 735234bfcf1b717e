"""Places of a phrase among the words of a text, position by position."""

import re


def places(text, phrase):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own, want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower), phrase.split()
    return [i for i in range(len(own) - len(want) + 1) if own[i:i + len(want)] == want], len(own)
