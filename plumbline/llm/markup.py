"""HTML of whole Arrow columns as arrays of tokens: tags are read one by one, words in numpy."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from plumbline.llm.vectext import mix, range_hash, text_bytes

_SPECIAL = re.compile(rb"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that make the path of a token; others are tokens but don't nest.
BLOCKS = {*"html head title body nav header footer aside main section article div ul ol li table thead tbody tr td th form h1 h2 h3 h4 h5 h6 pre blockquote figure".split()}
#: Tags that end a run of words.
BREAKS = BLOCKS | {"p", "br", "hr", "script", "style"}
#: A path names so many of the innermost blocks.
DEEP = 40
#: Tags, paths and steps that a reader keeps before it forgets them.
KEEP = 200_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens(NamedTuple):
    """Tokens of all pages, in order. role: tells tokens apart, the last bit set for words; page: whose; start, end: byte places in data (of words); path: number in paths; ends: tags that end a run of words."""

    role: np.ndarray
    page: np.ndarray
    start: np.ndarray
    end: np.ndarray
    path: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    paths: list[str]


class Reader:
    """Keeps what it has learned of tags and paths from one call to the next."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.paths: list[str] = [""]
        self.numbers: dict[str, int] = {"": 0}
        self.tags: dict[bytes, tuple[str, str]] = {}
        self.steps: dict[tuple[int, str, str], tuple[int, int, int, bool]] = {}

    def _tag(self, raw: bytes) -> tuple[str, str]:
        """(sort of tag, its name with class and id): sort is "<", "/", "." (one that doesn't nest) or "?"."""
        text = raw.decode("utf8", "replace")
        name = _NAME.match(text)
        if not name:
            return "?", text[:2]
        tag = name[1].lower()
        if text[1] == "/":
            return "/", tag
        marks = ".".join(sorted({w for c in _CLASS.findall(text) for w in "".join(c).split()})) if "=" in text else ""
        return ("<" if tag in BLOCKS and not text.endswith("/>") else "."), f"{tag}.{marks}" if marks else tag

    def _step(self, state: int, sort: str, own: str) -> tuple[int, int, int, bool]:
        """(path after the tag, role of the tag, hash of what follows, whether it ends a run of words)."""
        path = self.paths[state]
        tag = own.partition(".")[0]
        after = path
        if sort == "/" and tag in BLOCKS:
            parts = path.split("/") if path else []
            at = next((k for k in range(len(parts) - 1, -1, -1) if parts[k].partition(".")[0] == tag), None)
            after = path if at is None else "/".join(parts[:at])
        elif sort == "<":
            after = "/".join([*path.split("/"), own][-DEEP:]) if path else own
        if after not in self.numbers:
            self.numbers[after] = len(self.paths)
            self.paths.append(after)
        role = xxhash.xxh3_64_intdigest(f"{after if sort == '/' else path} <{'/' if sort == '/' else ''}{own}>") & ~1
        return self.numbers[after], role, xxhash.xxh3_64_intdigest(f"{after} {'/' if sort == '/' else ''}{tag} "), tag in BREAKS

    def read(self, texts: pa.Array) -> Tokens:
        if max(len(self.tags), len(self.paths), len(self.steps)) > KEEP:
            self._forget()
        whole, offsets = text_bytes(texts)
        data, n = whole.copy(), len(whole)
        buffer = whole.tobytes()
        special: list[tuple[int, int, bytes]] = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for m in _SPECIAL.finditer(buffer, a, b):
                data[m.start() : m.end()] = 32
                if m[1]:
                    special.append((m.start(), m.end(), b"<" + m[1].lower() + b">"))
        brackets = np.flatnonzero((data == 60) | (data == 62))
        opens = data[brackets] == 60
        owner = np.searchsorted(offsets, brackets, side="right")
        pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (owner[:-1] == owner[1:])) if len(brackets) > 1 else np.zeros(0, np.int64)
        begin, end = brackets[pair], brackets[pair + 1] + 1
        raws = [buffer[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        if special:
            begin = np.concatenate([begin, np.array([s[0] for s in special], np.int64)])
            end = np.concatenate([end, np.array([s[1] for s in special], np.int64)])
            raws += [s[2] for s in special]
            order = np.argsort(begin)
            begin, end, raws = begin[order], end[order], [raws[k] for k in order.tolist()]
        page = np.searchsorted(offsets, begin, side="right") - 1

        # tags, one by one
        state, last = 0, -1
        path, role, follows, breaks = [], [], [], []
        tags, steps = self.tags, self.steps
        for raw, own_page in zip(raws, page.tolist(), strict=True):
            if own_page != last:
                state, last = 0, own_page
            tag = tags.get(raw)
            if tag is None:
                tag = tags[raw] = self._tag(raw)
            key = (state, *tag)
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._step(*key)
            state = step[0]
            path.append(state)
            role.append(step[1])
            follows.append(step[2])
            breaks.append(step[3])

        # words: runs of bytes that are neither white space nor in a tag
        depth = np.zeros(n + 1, np.int32)
        np.add.at(depth, begin, 1)
        np.add.at(depth, end, -1)
        inside = ~_SPACE[data] & (np.cumsum(depth[:-1]) == 0)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets[(offsets > 0) & (offsets < n)]] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        word_page = np.searchsorted(offsets, start, side="right") - 1
        tag_before = np.searchsorted(begin, start) - 1
        none = (tag_before < 0) | (page[np.maximum(tag_before, 0)] != word_page) if len(begin) else np.ones(len(start), dtype=bool)
        group = np.where(none, -1 - word_page, tag_before)
        fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]]))
        since = (np.arange(len(group)) - np.repeat(fresh, np.diff(np.append(fresh, len(group))))).astype(np.uint64)
        follow, tag_path = np.array(follows, np.uint64), np.array(path, np.int64)
        at = np.where(none, 0, tag_before)
        context = np.where(none, np.uint64(0), follow[at]) if len(begin) else np.zeros(len(start), np.uint64)
        word_path = np.where(none, 0, tag_path[at]) if len(begin) else np.zeros(len(start), np.int64)
        word_role = mix(context + since * np.uint64(0x9E3779B97F4A7C15) + range_hash(whole, start, stop)) | np.uint64(1)

        order = np.argsort(np.concatenate([begin, start]), kind="stable")
        both = lambda a, b: np.concatenate([a, b])[order]
        return Tokens(
            both(np.array(role, np.uint64), word_role), both(page, word_page), both(begin, start), both(end, stop), both(tag_path, word_path),
            both(np.array(breaks, bool), np.zeros(len(start), bool)), whole, self.paths,
        )
