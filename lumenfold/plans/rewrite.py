"""Query rewriting on the driver: tokens, automatic fuzziness, combination; sort specs and guards."""

from __future__ import annotations

import re
from enum import Enum


class Mode(Enum):
    SEARCH = " "
    LOOKUP = " AND "


def split_nested(query: str) -> list[str]:
    """Tokens at spaces outside brackets and quotes.

    A closing bracket, or a quote before a space or the end, lowers the depth; any other bracket or quote
    raises it. So a quote followed by a tilde raises it, and everything after stays one token.
    """
    out, word, depth = [], "", 0
    for i, ch in enumerate(query):
        closing = ch in ")]" or (ch == '"' and query[i + 1 : i + 2] in ("", " "))
        if ch == " " and depth == 0:
            out.append(word)
            word = ""
            continue
        if closing:
            depth -= 1
        elif ch in '(["':
            depth += 1
        word += ch
    return [*out, word]


def fuzzify(token: str) -> str:
    t = token.strip()
    plain = t[:1] not in ("+", "-") and not any(ch in t for ch in '~:^("')
    return t + "~" if plain else t


def enhance_query(query: str, mode: Mode) -> str:
    return mode.value.join(fuzzify(t) for t in split_nested(query))


def mode_of(sort_fields: str | None) -> Mode:
    return Mode.LOOKUP if sort_fields else Mode.SEARCH


def parse_sort(spec: str | None) -> list[tuple[str, bool, bool]]:
    """(field, ascending, numeric) of each part of "field:dir,..."; none for an empty spec.

    Fields whose name begins with number sort as integers, ascending whatever the direction says.
    """
    out = []
    for part in (spec or "").split(",") if spec else []:
        field, sep, direction = part.partition(":")
        numeric = field.startswith("number")
        if not numeric and (not sep or direction.lower() not in ("asc", "desc")):
            raise ValueError(f"a sort needs field:asc or field:desc, not {part!r}")
        out.append((field, numeric or direction.lower() == "asc", numeric))
    return out


def page_bounds(page: int = 1, per_page: int = 20) -> tuple[int, int]:
    """(offset, limit); a page has 100 records at most."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page begin at 1")
    size = min(per_page, 100)
    return (page - 1) * size, size


def check_prefix(prefix: str) -> str:
    if len(prefix) < 2:
        raise ValueError("a prefix needs two characters")
    return prefix


def check_size(size: int) -> int:
    if not 1 <= size <= 10:
        raise ValueError("size lies between 1 and 10")
    return size


def check_query(query: str) -> bool:
    """Whether the client sends a query: two characters at least, blanks at the ends not counted."""
    return len(query.strip()) >= 2


def input_terms(text: str) -> list[str]:
    """Terms of a comma list, trailing empty ones dropped; only commas are an error."""
    terms = text.split(",")
    while len(terms) > 1 and terms[-1] == "":
        terms.pop()
    if terms == [""] and text:
        raise ValueError("no terms")
    return terms


def searchable_terms(terms: list[str]) -> list[str]:
    """Inputs that are no phrases."""
    return [t for t in terms if " " not in t.strip() and not t.strip().startswith('"')]


def drill_down(book: str, chapter: str = "", section: str = "", part: str = "", volume: str = "") -> tuple[str, str]:
    """Query and sort spec that list a book, or a division of it."""
    bare = lambda x: re.sub(r"<(?:.|\n)*?>", "", x).strip()
    query, sort = f'book:"{bare(book)}"', ["number:asc"]
    for name, value in (("chapter", chapter), ("section", section), ("part", part), ("volume", volume)):
        if value:
            value = bare(value).replace("Volume", "", 1).strip() if name == "volume" else bare(value)
            query += f' {name}:"{value}"'
            order = ("volume", "part", "section", "chapter")
            sort = [f"{n}:asc" for n in order[order.index(name) :]] + ["number:asc"]
    return query, ",".join(sort)


def page_list(total: int, page: int, size: int = 20, most: int = 500, pages: int = 20) -> dict[str, object]:
    """What a pager shows: the capped total, the pages, and whether there are neighbours."""
    shown = min(total, most)
    return {
        "total": shown,
        "pages": [n for n in range(1, pages + 1) if n <= -(-shown // size)] if shown > size else [],
        "previous": page > 1,
        "next": page < pages and shown / size > page,
    }
