"""JSON objects in free text, and the elements of a JSON stream.

``spans`` finds what a reader would who tries every ``{`` from left to right, takes the first whole object, and goes on behind it.
Trying each brace anew would read a broken text again and again. The scanner keeps a stack of what is open instead: where the
text breaks, everything open is broken too and everything closed is whole, so each brace is settled when it is met
first. Only braces inside the strings of something broken are tried on their own. There is no recursion, so depth does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"')
_PLAIN = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|null|true|false|NaN|-?Infinity")

#: What may come next.
VALUE, FIRST_VALUE, KEY, FIRST_KEY, COLON, AFTER = range(6)


def _scan(text: str, start: int, whole: dict[int, int], broken: set[int]) -> None:
    """Read from the brace at ``start`` until it is closed or the text breaks; note where each object ends, or that it does not."""
    stack: list[int] = []  # places of open brackets
    at, want, size = start, VALUE, len(text)
    while True:
        at = _BLANK.match(text, at).end()
        c = text[at] if at < size else ""
        if want in (VALUE, FIRST_VALUE) and c in ("{", "["):
            if at in broken:
                break
            if at in whole:  # read before
                at, want = whole[at], AFTER
                continue
            stack.append(at)
            at, want = at + 1, FIRST_KEY if c == "{" else FIRST_VALUE
        elif (want == AFTER or (want == FIRST_KEY and c == "}") or (want == FIRST_VALUE and c == "]")) and c and c == {"{": "}", "[": "]"}[text[stack[-1]]]:
            begun = stack.pop()
            at += 1
            if text[begun] == "{":
                whole[begun] = at
            if not stack:
                return
            want = AFTER
        elif want == AFTER and c == ",":
            at, want = at + 1, KEY if text[stack[-1]] == "{" else VALUE
        elif want == COLON and c == ":":
            at, want = at + 1, VALUE
        elif want in (KEY, FIRST_KEY, VALUE, FIRST_VALUE):
            key = want in (KEY, FIRST_KEY)
            hit = _STRING.match(text, at) if c == '"' else None if key else _PLAIN.match(text, at)
            if hit is None:
                break
            at, want = hit.end(), COLON if key else AFTER
        else:
            break
    broken.update(stack)
    broken.add(start)


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every JSON object of a text that is not inside another one found."""
    whole: dict[int, int] = {}
    broken: set[int] = set()
    at = text.find("{")
    while at != -1:
        if at not in whole and at not in broken:
            _scan(text, at, whole, broken)
        end = whole.get(at)
        if end is not None:
            yield at, end
        at = text.find("{", at + 1 if end is None else end)


@udtf(returnType="place int, start int, stop int, object string")
class JsonObjects:
    """``LATERAL json_objects(text)``: the objects of a text, numbered from 1, with code point offsets."""

    def eval(self, text: str):
        for place, (start, stop) in enumerate(spans(text or ""), 1):
            yield place, start, stop, text[start:stop]


def json_objects(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` once for every JSON object in a text: ``place, start, stop, object``. Rows without one do not come back; a null text has none."""
    return df.lateralJoin(JsonObjects(F.col(text_col).outer()))


class Elements:
    """The elements of a JSON array, or the objects of a JSON-lines text, fed in chunks of any size.

    What is fed must be JSON; only nesting and strings are followed, so an element may span any number of chunks.
    """

    _MARK = re.compile(r'[\[\]{}"\\,\n]')

    def __init__(self):
        self.rest, self.at, self.depth, self.quoted, self.inside = "", 0, 0, False, None

    def feed(self, chunk: str) -> Iterator[str]:
        """Elements that are complete now."""
        text, at, begun = self.rest + chunk, self.at, 0
        if self.inside is None:
            lead = text.lstrip("\ufeff \t\r\n")
            if not lead:
                return
            self.inside = lead[0] == "["
            if self.inside:
                begun = at = text.index("[") + 1
        while hit := self._MARK.search(text, at):
            c, at = hit.group(), hit.end()
            if self.quoted:
                if c == "\\":
                    if at == len(text):  # what it escapes is in the next chunk
                        at -= 1
                        break
                    at += 1
                elif c == '"':
                    self.quoted = False
            elif c == '"':
                self.quoted = True
            elif c in "[{":
                self.depth += 1
            elif c in "]}":
                self.depth -= 1
            if not self.quoted and (self.depth == -1 or (self.depth == 0 and c == ("," if self.inside else "\n"))):
                if part := text[begun : at - 1].strip():
                    yield part
                begun = at
        else:
            at = len(text)
        self.rest, self.at = text[begun:], at - begun

    def close(self) -> Iterator[str]:
        """What is left at the end: the last line of JSON lines."""
        if self.inside is False and (part := self.rest.strip()):
            yield part
