"""Suffix automata over word sequences."""

from __future__ import annotations

import numpy as np


class Builder:
    """Grows the automaton of a sequence symbol by symbol."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        self.end = [0]  # of each state, where the first occurrence of its strings ends

    def add(self, symbol: int) -> None:
        nxt, link, length, end = self.next, self.link, self.length, self.end
        new, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        end.append(length[new])
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new


def build(passages: list[list[str]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of all substrings of the passages; none runs from one passage into the next.

    The passages lie one after the other with a mark behind each; "first" are the places where they begin.
    """
    ids: dict[str, int] = {}
    own = Builder()
    cut = 1 << 31  # marks between passages, each of its own kind
    first = []
    for words in passages:
        first.append(own.length[own.last])
        for w in words:
            own.add(ids.setdefault(w, len(ids)))
        own.add(cut)
        cut += 1
    edges = [(state << 32 | symbol, target) for state, follow in enumerate(own.next) for symbol, target in follow.items() if symbol < 1 << 31]
    text = "\n".join(ids).encode()
    return {
        "words": np.frombuffer(text, np.uint8),
        "edges": np.array([e for e, _ in edges], np.int64),
        "targets": np.array([t for _, t in edges], np.int32),
        "link": np.array(own.link, np.int32),
        "length": np.array(own.length, np.int32),
        "end": np.array(own.end, np.int32),
        "first": np.array(first, np.int64),
    }


class Matcher:
    """Matching statistics of word sequences against a stored automaton."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        text = arrays["words"].tobytes().decode()
        self.ids = {w: i for i, w in enumerate(text.split("\n"))} if text else {}
        self.go = dict(zip(arrays["edges"].tolist(), arrays["targets"].tolist(), strict=True))
        self.link, self.length, self.end = arrays["link"].tolist(), arrays["length"].tolist(), arrays["end"].tolist()

    def matches(self, words: list[str]) -> list[tuple[int, int]]:
        """For each place the length of the longest run of words ending there that occurs in a passage, and where it ends there."""
        go, link, length, end, known = self.go.get, self.link, self.length, self.end, self.ids.get
        state, size, out = 0, 0, []
        for w in words:
            symbol = known(w)
            if symbol is None:
                state, size = 0, 0
            else:
                target = go(state << 32 | symbol)
                while target is None and state:
                    state = link[state]
                    size = length[state]
                    target = go(state << 32 | symbol)
                if target is None:
                    size = 0
                else:
                    state, size = target, size + 1
            out.append((size, end[state]))
        return out

    def statistics(self, words: list[str]) -> list[int]:
        """For each place the length of the longest run of words ending there that occurs in a passage."""
        return [size for size, _ in self.matches(words)]
