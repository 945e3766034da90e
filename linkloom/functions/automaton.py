"""Many phrases looked for in one pass."""

from __future__ import annotations

from collections import deque


class Automaton:
    """Phrases (keys joined by spaces) as a trie with failure links: a run of keys is read once, whatever the number of phrases.

    `ends` of a state is the number of words of the phrase that ends there, if any; `shorter` leads to the next state along
    the failure links at which another phrase ends.
    """

    def __init__(self, phrases: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for phrase in phrases:
            state, words = 0, phrase.split(" ")
            for key in words:
                if key not in self.next[state]:
                    self.next[state][key] = len(self.next)
                    self.next.append({})
                    self.ends.append(0)
                state = self.next[state][key]
            self.ends[state] = len(words)
        self.fail, self.shorter = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for key, to in self.next[state].items():
                back = self.fail[state]
                while back and key not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(key, 0)
                self.shorter[to] = self.fail[to] if self.ends[self.fail[to]] else self.shorter[self.fail[to]]
                queue.append(to)

    def matches(self, keys: list[str]) -> list[tuple[int, int]]:
        """(first word, words) of every phrase in a run, by its last word, the longest first."""
        out, state = [], 0
        for i, key in enumerate(keys):
            while state and key not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(key, 0)
            found = state if self.ends[state] else self.shorter[state]
            while found:
                out.append((i + 1 - self.ends[found], self.ends[found]))
                found = self.shorter[found]
        return out
