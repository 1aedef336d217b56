"""Finding all of a text's own literal values in one pass over it.

Spark has no search for many patterns at once: a chain of ``replace`` or ``split``, one for each value,
reads the text as often as it has values. These two functions read it once, in Arrow batches, and their
cost grows with the text and what is found in it. Everything they need is nested in the
functions that make them, so Python workers get it with the task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE_BITS = 32


def _searcher():
    """search(patterns)(text): all (start, pattern number) where a pattern stands, starts rising.

    Patterns are distinct and not empty. They are looked up by their first characters, and then whole,
    once for each length that begins so: never one by one.
    """
    head_size = 4

    def search(patterns: list[str]):
        number = {p: i for i, p in enumerate(patterns)}
        lengths: dict[str, set[int]] = {}
        for p in patterns:
            lengths.setdefault(p[:head_size], set()).add(len(p))
        by_size: dict[int, dict[str, list[int]]] = {}
        for head, sizes in lengths.items():
            by_size.setdefault(len(head), {})[head] = sorted(sizes)

        def find(text: str) -> list[tuple[int, int]]:
            out = []
            for size, heads in by_size.items():
                for at in range(len(text) - size + 1):
                    sizes = heads.get(text[at:at + size])
                    if sizes:
                        for n in sizes:
                            found = number.get(text[at:at + n])
                            if found is not None and at + n <= len(text):
                                out.append((at, found))
            out.sort()
            return out

        return find

    return search


def _places_udf():
    search = _searcher()

    def own(text, types, values) -> list[int]:
        firsts: dict[str, list[int]] = {}  # a value's first span of each type
        seen = set()
        for i, (kind, value) in enumerate(zip(types, values)):
            if value and (kind, value) not in seen:
                seen.add((kind, value))
                firsts.setdefault(value, []).append(i)
        words = list(firsts)
        reached = [0] * len(words)
        out = []
        for at, w in search(words)(text):
            value = words[w]
            end = at + len(value)
            glued = (at > 0 and value[0].isalnum() and text[at - 1].isalnum()) or (
                end < len(text) and value[-1].isalnum() and text[end].isalnum())
            if at >= reached[w] and not glued:
                reached[w] = end
                out.extend((i << 32) + at for i in firsts[value])
        return out

    def places(text, types, values):
        import pandas as pd
        return pd.Series([[] if t is None or v is None or not len(v) else own(t, k, v)
                          for t, k, v in zip(text, types, values)], dtype=object)

    return F.pandas_udf(places, "array<bigint>")


def value_places(text: Column, spans: Column) -> Column:
    """Where the values of a text's spans stand in it as whole words.

    One number for each place: the first span of that type and value, shifted by PLACE_BITS, plus the
    start. Places of one value do not overlap. A word is not cut: a value's letter or digit at its
    edge has none beside it. Empty without text or spans.
    """
    return _places_udf()(text, F.transform(spans, lambda s: s["pii_type"]),
                         F.transform(spans, lambda s: s["value"]))


def _restored_udf():
    from bisect import bisect_right

    search = _searcher()

    def chain(text: str, steps: list[tuple[str, str]]) -> str:
        for old, new in steps:
            text = text.replace(old, new)
        return text

    def steps_of(synthetic, real) -> list[tuple[str, str]]:
        steps = []
        for old, new in zip(synthetic, real):
            if old:
                steps.append((old, new))
            head, own = (old.split(None, 1) or [""])[0], (new.split(None, 1) or [""])[0]
            if len(head) > 2:
                steps.append((head + "'s", own + "'s"))
        return steps

    def one(text: str, synthetic, real) -> str:
        steps = steps_of(synthetic, real)
        if not steps:
            return text
        # A repeated step counts as the first; as the last where something new could meet it.
        last = {old: i for i, (old, _) in enumerate(steps)}
        news: dict[str, str] = {}
        for old, new in steps:
            news.setdefault(old, new)
        olds = list(news)
        latest = [last[old] for old in olds]
        find = search(olds)
        # In the order of the steps; what an earlier one takes is gone for a later one.
        taken = bytearray(len(text))
        regions = []
        for at, step in sorted(find(text), key=lambda f: (f[1], f[0])):
            end = at + len(olds[step])
            if taken.find(1, at, end) < 0:
                taken[at:end] = b"\1" * (end - at)
                regions.append((at, end, step))
        if not regions:
            return text
        regions.sort()
        out, marks, size, reached = [], [], 0, 0
        for at, end, step in regions:
            new = news[olds[step]]
            out += [text[reached:at], new]
            size += at - reached
            marks.append((size, size + len(new), step))
            size, reached = size + len(new), end
        result = "".join(out) + text[reached:]
        order = {old: i for i, (old, _) in reversed(list(enumerate(steps)))}
        starts = [order[old] for old in olds]
        if makes_new(text, result, regions, marks, olds, news, starts, latest, find):
            return chain(text, steps)
        return result

    def makes_new(text, result, regions, marks, olds, news, starts, latest, find) -> bool:
        """Could a later step of the chain meet what an earlier one has put in?

        A value that stands whole inside another one could join three pieces, so it counts as a yes, and
        so does one that leaves nothing behind. Else an occurrence touches at most two neighbours,
        put in or still as they were.
        """
        used = {step for *_, step in regions}
        pieces = list({p for step in used for p in (olds[step], news[olds[step]])})
        if "" in pieces:
            return True
        joined, ends, size = "\0".join(olds), [], 0
        for old in olds:
            size += len(old) + 1
            ends.append(size)
        put_in = {news[olds[step]] for step in used}
        for at, p in search(pieces)(joined):
            whole, piece = olds[bisect_right(ends, at)], pieces[p]
            # The possessive of a one-word value comes right after the value: none of that is left by then.
            if len(piece) < len(whole) and (piece in put_in or whole != piece + "'s"):
                return True
        for at, step in find(result):
            if any(latest[step] > starts[i] for i in touched(marks, at, at + len(olds[step]))):
                return True
        reach = max(map(len, olds)) - 1
        for (at, end, own), (a, b, _) in zip(regions, marks):
            left = text[max(0, at - reach):at]
            if any(latest[step] > starts[own] and p < len(left) + b - a and p + len(olds[step]) > len(left)
                   for p, step in find(left + result[a:b] + text[end:end + reach])):
                return True
        return False

    def touched(marks, at: int, end: int):
        i = max(0, bisect_right(marks, (at, float("inf"), 0)) - 1)
        while i < len(marks) and marks[i][0] < end:
            if marks[i][1] > at:
                yield marks[i][2]
            i += 1

    def restored(text, synthetic, real):
        import pandas as pd
        return pd.Series([None if t is None or s is None or r is None or any(x is None for x in (*s, *r))
                          else one(t, list(s), list(r)) for t, s, r in zip(text, synthetic, real)], dtype=object)

    return F.pandas_udf(restored, "string")


def restored_text(text: Column, mappings: Column) -> Column:
    """Replace synthetic by real values, in the order of the mappings, as a chain of replacements does.

    After each value, the possessive of its first word (longer than two characters) is replaced as
    well. All occurrences are found in one pass. Where something put in could become an occurrence
    of a later step, the chain itself is run for that text. Null for a null text or value.
    """
    return _restored_udf()(text, F.transform(mappings, lambda m: m["synthetic"]),
                           F.transform(mappings, lambda m: m["real"]))
