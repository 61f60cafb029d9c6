"""Probabilistic automata by merging compatible states of a prefix tree (ALERGIA)."""

from __future__ import annotations

import math

#: Characters of candidates.
ALPHABET = 66
#: Weight of each unseen character.
PRIOR = 0.05


#: States that fewer strings reach are not tested.
FEW = 10
#: Lengths on either side that count with an observed one, and the weight of a length never seen.
SPREAD, UNSEEN_LENGTH = 1, 0.02


class Automaton:
    """``step[state]`` holds per character (next state, log probability), ``other[state]`` the log probabilities of characters that the state has not seen ("": of those not seen at all).

    Transitions say nothing of where a string ends; that is left to ``length``, the log probabilities of lengths.
    """

    def __init__(self, step: list[dict[str, tuple[int, float]]], other: list[dict[str, float]], length: dict[int, float], rare: float):
        self.step, self.other, self.length, self.rare = step, other, length, rare

    def score(self, text: str) -> float:
        """Log-likelihood of the text as a whole. An unseen character keeps the state."""
        state, total = 0, self.length.get(len(text), self.rare)
        step, other = self.step, self.other
        for c in text:
            hit = step[state].get(c)
            if hit is None:
                unseen = other[state]
                total += unseen[c] if c in unseen else unseen[""]
            else:
                state = hit[0]
                total += hit[1]
        return total


def lengths_of(strings: list[str], longest: int) -> tuple[dict[int, float], float]:
    """Log probabilities of lengths, spread over their neighbours, and that of each other length."""
    weight: dict[int, float] = {}
    for s in strings:
        for n in range(len(s) - SPREAD, len(s) + SPREAD + 1):
            weight[n] = weight.get(n, 0) + (1 - UNSEEN_LENGTH) / (2 * SPREAD + 1) / len(strings)
    rare = UNSEEN_LENGTH / longest
    return {n: math.log(w + rare) for n, w in weight.items()}, math.log(rare)


def learn(strings: list[str], alpha: float = 0.01, longest: int = 200) -> Automaton:
    """An automaton for the strings: a blue state joins the red state with compatible frequencies that makes what follows it likeliest, else turns red."""
    passed, ended, to = [0], [0], [{}]
    for s in strings:
        at = 0
        passed[0] += 1
        for c in s:
            nxt = to[at].get(c)
            if nxt is None:
                nxt = len(to)
                to[at][c] = nxt
                passed.append(0)
                ended.append(0)
                to.append({})
            at = nxt
            passed[at] += 1
        ended[at] += 1
    # passed counts arrivals; what leaves a state by a character is kept with the edge
    leave = [{c: passed[n] for c, n in t.items()} for t in to]
    uniform = -math.log(ALPHABET)
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = passed[a], passed[b]
            if n == 0 or m == 0:
                continue
            if differ(ended[a], n, ended[b], m):
                return False
            for c in leave[a].keys() | leave[b].keys():
                if differ(leave[a].get(c, 0), n, leave[b].get(c, 0), m):
                    return False
                if c in to[a] and c in to[b]:
                    # deep down the tree few strings are left, which never differ
                    if passed[to[b][c]] > 2:
                        todo.append((to[a][c], to[b][c]))
        return True

    def likely(a: int, b: int) -> float:
        """Log-likelihood of all that follows b, if it went on from a; where a's paths end, any character is as likely."""
        out, todo = 0.0, [(a, b)]
        while todo:
            a, b = todo.pop()
            n = passed[a] + PRIOR * ALPHABET if a >= 0 else 0
            if a >= 0 and ended[b]:
                out += ended[b] * math.log((ended[a] + PRIOR) / n)
            for c, k in leave[b].items():
                out += k * (math.log((leave[a].get(c, 0) + PRIOR) / n) if a >= 0 else uniform)
                todo.append((to[a].get(c, -1) if a >= 0 else -1, to[b][c]))
        return out

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            passed[a] += passed[b]
            ended[a] += ended[b]
            for c, n in to[b].items():
                if c in to[a]:
                    leave[a][c] += leave[b][c]
                    todo.append((to[a][c], n))
                else:
                    to[a][c], leave[a][c] = n, leave[b][c]

    red = [0]
    at = 0
    while at < len(red):
        q = red[at]
        grown = False
        for c in sorted(to[q]):
            blue = to[q][c]
            if blue in red:
                continue
            # too few strings to tell: a rare character keeps the state, as an unseen one does
            home = q if passed[blue] < FEW else max((r for r in red if compatible(r, blue)), key=lambda r: likely(r, blue), default=None)
            if home is None:
                red.append(blue)
            else:
                to[q][c] = home
                fold(home, blue)
                grown = True
        # folding may have hung new states below a state already passed
        at = 0 if grown else at + 1
    number = {q: i for i, q in enumerate(red)}
    # a state that was left by many different characters gives more to those it has not seen (Witten and Bell), by how common they are
    every: dict[str, int] = {}
    for c in "".join(strings):
        every[c] = every.get(c, 0) + 1
    size = sum(every.values()) + ALPHABET
    common = {c: (k + 1) / size for c, k in every.items()}
    step, other = [], []
    for q in red:
        n, kinds = passed[q] - ended[q], len(to[q]) + 1
        step.append({c: (number[x], math.log((leave[q][c] + kinds * common[c]) / (n + kinds))) for c, x in to[q].items()})
        other.append({c: math.log(kinds * p / (n + kinds)) for c, p in common.items() if c not in to[q]} | {"": math.log(kinds / size / (n + kinds))})
    return Automaton(step, other, *lengths_of(strings, longest))
