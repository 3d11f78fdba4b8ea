"""Minimal acyclic automata of sorted words, with word numbers, and their search with one error (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator


class Automaton:
    """The minimal automaton of ``words`` (sorted, distinct): a word's number is its place among them.

    Built word by word: what a new word no longer shares with the one before is finished, and
    states with equal ends are one state. An edge carries how many words of its state come
    before those behind it, so the numbers add up along a path.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        counts: list[int] = []

        def finished(ends: bool, out: list[tuple[str, int]]) -> int:
            at = known.get(shape := (ends, tuple(out)))
            if at is None:
                at = known[shape] = len(self.edges)
                before, own = int(ends), {}
                for c, to in out:
                    own[c] = (to, before)
                    before += counts[to]
                self.edges.append(own)
                self.final.append(ends)
                counts.append(before)
            return at

        open_: list[list] = [[False, []]]  # of each letter of the last word: whether a word ends there, its finished edges
        last = ""
        for word in [*words, ""]:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            for i in range(len(last) - 1, shared - 1, -1):
                open_[-2][1].append((last[i], finished(*open_.pop())))
            open_ += [[False, []] for _ in word[shared:]]
            if word:
                open_[-1][0] = True
            last = word
        self.start = finished(*open_[0])

    def _walked(self, state: int, word: str, at: int, number: int) -> tuple[int, int] | None:
        for i in range(at, len(word)):
            step = self.edges[state].get(word[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def with_one_error(self, exact: str, rest: str) -> Iterator[int]:
        """Numbers of the words that begin with ``exact`` and go on like ``rest`` but for one letter replaced or added.

        Each comes once: a letter added to a row of its like is added at the row's end.
        """
        found = self._walked(self.start, exact, 0, 0)
        if found is None:
            return
        state, number = found
        for i in range(len(rest) + 1):
            own = rest[i] if i < len(rest) else None
            for c, (to, before) in self.edges[state].items():
                if c == own:
                    continue
                for at in (i,) if own is None else (i, i + 1):
                    end = self._walked(to, rest, at, number + before)
                    if end is not None and self.final[end[0]]:
                        yield end[1]
            if own is None or own not in self.edges[state]:
                return
            to, before = self.edges[state][own]
            state, number = to, number + before
