"""Rule expressions compiled to one minimal deterministic automaton over bytes:
a position automaton from the parsed expressions, subset construction, and
minimisation by partition refinement, as transition arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

import numpy as np

_CATEGORY = {K.CATEGORY_DIGIT: "0-9", K.CATEGORY_SPACE: " \t-\r", K.CATEGORY_WORD: "0-9A-Za-z_"}


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[np.ndarray, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def link(self, a: int, b: int) -> None:
        self.empty[a].append(b)


def _set(items, fold: bool) -> np.ndarray:
    out, negated = np.zeros(256, bool), False
    for op, arg in items:
        if op is K.NEGATE:
            negated = True
        elif op is K.LITERAL:
            out[arg] = True
        elif op is K.RANGE:
            out[arg[0]:arg[1] + 1] = True
        elif op is K.CATEGORY and arg in _CATEGORY:
            out[[c for c in range(256) if re.match(f"[{_CATEGORY[arg]}]".encode(), bytes([c]))]] = True
        else:
            raise ValueError(f"not supported in a rule: {op} {arg}")
    if fold:
        upper, lower = slice(65, 91), slice(97, 123)
        either = out[upper] | out[lower]
        out[upper] = out[lower] = either
    return ~out if negated else out


def _add(nfa: _Nfa, parsed, start: int, fold: bool) -> int:
    """Append a parsed sequence after ``start``; returns its end state."""
    at = start
    for op, arg in parsed:
        if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
            items = {K.LITERAL: [(K.LITERAL, arg)], K.NOT_LITERAL: [(K.NEGATE, None), (K.LITERAL, arg)], K.IN: arg, K.ANY: [(K.NEGATE, None), (K.LITERAL, 10)]}[op]
            new = nfa.state()
            nfa.step[at] = (_set(items, fold), new)
            at = new
        elif op is K.SUBPATTERN:
            at = _add(nfa, arg[3], at, fold or bool(arg[1] & re.I))
        elif op is K.BRANCH:
            end = nfa.state()
            for part in arg[1]:
                first = nfa.state()
                nfa.link(at, first)
                nfa.link(_add(nfa, part, first, fold), end)
            at = end
        elif op is K.MAX_REPEAT:
            least, most, part = arg
            for _ in range(least):
                at = _add(nfa, part, at, fold)
            if most is K.MAXREPEAT:
                loop, out = nfa.state(), nfa.state()
                nfa.link(at, loop)
                body = nfa.state()
                nfa.link(loop, body)
                nfa.link(loop, out)
                nfa.link(_add(nfa, part, body, fold), loop)
                at = out
            else:
                end = nfa.state()
                nfa.link(at, end)
                for _ in range(most - least):
                    body = nfa.state()
                    nfa.link(at, body)
                    at = _add(nfa, part, body, fold)
                    nfa.link(at, end)
                at = end
        else:
            raise ValueError(f"not supported in a rule: {op}")
    return at


@dataclass(frozen=True)
class Automaton:
    """next: (states, classes); cls: class of each byte; accept: bits of the rules that
    match up to here; dead: the state that nothing leaves (or -1); start is state 0."""

    next: np.ndarray
    cls: np.ndarray
    accept: np.ndarray
    dead: int

    def used(self) -> np.ndarray:
        """Bytes that some state goes on with (of an anchored automaton)."""
        return (self.next != self.dead).any(0)[self.cls]


def compile_rules(rules: list[bytes], anchored: bool = False) -> Automaton:
    """One automaton of all rules.  Unanchored, it reports every end of a match of
    any rule in one pass; anchored, matches that begin at the first byte."""
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for k, rule in enumerate(rules):
        first = nfa.state()
        nfa.link(root, first)
        ends.setdefault(_add(nfa, parser.parse(rule), first, False), 0)
        end = max(ends)
        ends[end] |= 1 << k

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for b in nfa.empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(s for s in seen if nfa.step[s] is not None or s in ends)

    # bytes that all steps treat alike are one class
    masks = np.array([s[0] for s in nfa.step if s is not None])
    _, cls = np.unique(masks, axis=1, return_inverse=True)
    cls = cls.reshape(-1)
    sample = [int(np.flatnonzero(cls == c)[0]) for c in range(cls.max() + 1)]

    begin = closure([root])
    index, todo, table, accept = {begin: 0}, [begin], [], []
    for states in todo:
        accept.append(sum(ends[s] for s in states if s in ends))
        row = []
        for c in sample:
            to = {nfa.step[s][1] for s in states if nfa.step[s] is not None and nfa.step[s][0][c]}
            new = closure(to) if anchored else closure(to) | begin
            if new not in index:
                index[new] = len(index)
                todo.append(new)
            row.append(index[new])
        table.append(row)
    return _minimal(np.array(table), cls, np.array(accept, np.int64))


def _minimal(table: np.ndarray, cls: np.ndarray, accept: np.ndarray) -> Automaton:
    """States that no input tells apart are one."""
    part = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = np.unique(part, return_index=True)[1]
    rank = np.argsort(np.argsort(order))  # by first state, so that the start stays 0
    keep = np.sort(order)
    table = rank[part[table[keep]]]
    accept = accept[keep]
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (accept == 0))
    return Automaton(table.astype(np.int32), cls.astype(np.uint8), accept, int(stuck[0]) if len(stuck) and stuck[0] else -1)
