"""Earley parsing with weighted context-free grammars.

A grammar is a list of ``(symbol, body, weight)``; a name that is no rule's symbol is a terminal, a class of
tokens.  A token may belong to several classes.  The weight of a parse is the sum of the weights of its
rules, and the best parse of the longest-scoring prefix is kept.
"""

from __future__ import annotations

Rule = tuple[str, tuple[str, ...], float]


class Grammar:
    """Rules prepared for prediction. Bodies aren't empty, so every completed part spans tokens."""

    def __init__(self, start: str, rules: list[Rule]):
        self.start, self.rules = start, rules
        self.by_symbol: dict[str, list[int]] = {}
        for i, (symbol, body, _) in enumerate(rules):
            if not body:
                raise ValueError(f"{symbol} has an empty body")
            self.by_symbol.setdefault(symbol, []).append(i)

    def parse(self, tokens) -> tuple[int, list[tuple[str, int, int]] | None, int]:
        """``(seen, spans, end)`` of the best parse of a prefix.

        ``tokens`` yields the classes of one token after the other and is read only as far as some parse is
        alive: ``seen`` is the number of tokens that were looked at, so an equal beginning has an equal result.
        ``spans`` are the symbols of the best parse with the tokens they cover, or None; ``end`` is where it ends.
        """
        columns: list[dict[tuple[int, int, int], tuple[float, tuple | None]]] = [{}]
        waiting: list[dict[str, list[tuple[int, int, int]]]] = [{}]
        todo: list[tuple[int, int, int]] = []
        rules, by_symbol = self.rules, self.by_symbol

        def add(column: int, state: tuple[int, int, int], score: float, back: tuple | None) -> None:
            old = columns[column].get(state)
            if old is None or score > old[0]:
                columns[column][state] = (score, back)
                todo.append(state)

        for r in by_symbol[self.start]:
            add(0, (r, 0, 0), rules[r][2], None)
        best, seen, source = None, 0, iter(tokens)
        while True:
            here = len(columns) - 1
            wanted: dict[str, list[tuple[int, int, int]]] = {}
            while todo:
                state = todo.pop()
                r, dot, origin = state
                symbol, body, _ = rules[r]
                score, _ = columns[here][state]
                if dot == len(body):
                    if symbol == self.start and origin == 0 and (best is None or score >= best[0]):
                        best = (score, here, state)
                    for parent in waiting[origin].get(symbol, ()):
                        pr, pdot, porigin = parent
                        add(here, (pr, pdot + 1, porigin), columns[origin][parent][0] + score, (parent, origin, state))
                    continue
                nxt = body[dot]
                if nxt in by_symbol:
                    queue = waiting[here].setdefault(nxt, [])
                    if state not in queue:
                        queue.append(state)
                    for q in by_symbol[nxt]:
                        if (q, 0, here) not in columns[here]:
                            add(here, (q, 0, here), rules[q][2], None)
                else:
                    queue = wanted.setdefault(nxt, [])
                    if state not in queue:
                        queue.append(state)
            if not wanted:
                break
            token = next(source, None)
            seen += 1
            if token is None:
                break
            columns.append({})
            waiting.append({})
            for name in token:
                for state in wanted.get(name, ()):
                    r, dot, origin = state
                    add(here + 1, (r, dot + 1, origin), columns[here][state][0], (state, here, None))
            if not columns[-1]:
                break
        if best is None:
            return seen, None, 0
        spans: list[tuple[str, int, int]] = []
        stack = [(best[1], best[2])]
        while stack:
            end, state = stack.pop()
            spans.append((rules[state[0]][0], state[2], end))
            at, cur = end, state
            while cur[1]:
                parent, before, child = columns[at][cur][1]
                if child is not None:
                    stack.append((at, child))
                at, cur = before, parent
        return seen, sorted(set(spans), key=lambda x: (x[1], -x[2])), best[1]
