"""Cheapest repair of a row of turns by generalised LR parsing with edits.

A sound conversation is a word of `(s?(ua)+)?` over the initials of system, user and assistant. Its
tables are made from the grammar below. All repairs are parsed side by side: the stacks form a graph,
as a longer stack shares what is below it, and two repairs that reach the same top go on as one, the
one of the smaller (cost, audit). What may follow depends on the top alone in this grammar, and so does
the order of the repairs, as none of two audits for the same rows and the same cost begins the other.
"""

from functools import lru_cache

# The role grammar; the first rule's left side is the start.
RULES = [
    ("conversation", ()),
    ("conversation", ("pairs",)),
    ("conversation", ("s", "pairs")),
    ("pairs", ("u", "a")),
    ("pairs", ("pairs", "u", "a")),
]
START, END = "conversation", "$"
NAMES = {"u": "user", "a": "assistant"}  # that a turn may be given
LEGAL = {"su", "ua", "au"}

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)


def _closed(items):
    items = set(items)
    todo = list(items)
    while todo:
        rule, dot = todo.pop()
        for n, (left, _) in enumerate(RULES):
            if RULES[rule][1][dot : dot + 1] == (left,) and (n, 0) not in items:
                items.add((n, 0))
                todo.append((n, 0))
    return frozenset(items)


def _followers():
    """The terminals that may stand behind each left side. No left side but the start can be empty."""
    lefts = {left for left, _ in RULES}
    first = {left: set() for left in lefts}
    follow = {left: {END} if left == START else set() for left in lefts}
    for _ in RULES:
        for left, right in RULES:
            if right:
                first[left] |= first.get(right[0], {right[0]})
            for here, behind in zip(right, [*right[1:], None]):
                if here in lefts:
                    follow[here] |= follow[left] if behind is None else first.get(behind, {behind})
    return follow


START_STATE = _closed((n, 0) for n, (left, _) in enumerate(RULES) if left == START)
_FOLLOW = _followers()


@lru_cache(maxsize=None)
def _goto(state, symbol):
    moved = {(n, dot + 1) for n, dot in state if RULES[n][1][dot : dot + 1] == (symbol,)}
    return _closed(moved) if moved else None


@lru_cache(maxsize=None)
def _reductions(state, terminal):
    done = [n for n, dot in state if dot == len(RULES[n][1])]
    return [n for n in done if terminal in _FOLLOW[RULES[n][0]]]


# A stack is (state, what is below it), or None below the first.
EMPTY = (START_STATE, None)


@lru_cache(maxsize=None)
def shifted(stack, terminal):
    """The stack after a terminal, or None where it cannot follow. At `END`, whether it is accepted."""
    state = stack[0]
    if terminal == END and any(RULES[n][0] == START for n in _reductions(state, END)):
        return True
    reduced = [n for n in _reductions(state, terminal) if RULES[n][0] != START]
    for n in reduced:
        below = stack
        for _ in RULES[n][1]:
            below = below[1]
        onto = _goto(below[0], RULES[n][0])
        found = onto and shifted((onto, below), terminal)
        if found:
            return found
    onto = _goto(state, terminal)
    return (onto, stack) if onto else None


def _all_stacks():
    """The stacks between turns, the first found for each top."""
    found, todo = {START_STATE: EMPTY}, [EMPTY]
    while todo:
        stack = todo.pop(0)
        for terminal in "sua":
            after = shifted(stack, terminal)
            if after and after[0] not in found:
                found[after[0]] = after
                todo.append(after)
    return list(found.values())


STACKS = _all_stacks()
_NUMBER = {stack[0]: n for n, stack in enumerate(STACKS)}


def _offer(tops, cost, audit, stack):
    if stack is None:
        return False
    known = tops.get(stack[0])
    if known is None or (cost, audit) < known[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def _with_inserts(tops):
    """Add the stacks that inserted turns lead to."""
    tops, todo = dict(tops), list(tops.values())
    while todo:
        cost, audit, stack = todo.pop()
        for terminal in NAMES:
            after = shifted(stack, terminal)
            if _offer(tops, cost + INSERT, audit + "I", after):
                todo.append(tops[after[0]])
    return tops


def parsed(tops, initial, fault):
    """The tops after one more turn: `initial` is s, u, a or anything else."""
    after = {}
    for cost, audit, stack in _with_inserts(tops).values():
        _offer(after, cost + DELETE, audit + "D", stack)
        if fault in (BLANK, DUPLICATE):
            continue
        extra = CUT_OFF if fault == TRUNCATED else 0
        if initial in ("s", "u", "a"):
            _offer(after, cost + extra, audit + "K", shifted(stack, initial))
        for terminal in NAMES:
            _offer(after, cost + REROLE + extra, audit + "R", shifted(stack, terminal))
    return after


def table(turns, entries):
    """For each stack before the turns, by number, the (cost, audit) to each stack behind them.
    `turns` holds (initial, fault); no turn is inserted behind the last."""
    out = {}
    for entry in entries:
        tops = {STACKS[entry][0]: (0, "", STACKS[entry])}
        for initial, fault in turns:
            tops = parsed(tops, initial, fault)
        out[entry] = {_NUMBER[top]: (cost, audit) for top, (cost, audit, _) in tops.items()}
    return out


ENTRIES = range(len(STACKS))


@lru_cache(maxsize=None)
def _closing(entry):
    """The cheapest turns to insert at the end."""
    tops = _with_inserts({STACKS[entry][0]: (0, "", STACKS[entry])})
    return min((cost, audit) for cost, audit, stack in tops.values() if shifted(stack, END))


def _less(a, b):
    """Whether chain a of audits, linked from the last, is less than b; both have one for each table."""
    least = False
    while a is not b:
        if a[1] != b[1]:
            least = a[1] < b[1]
        a, b = a[0], b[0]
    return least


def cheapest(tables):
    """The least (cost, audits) of a conversation cut into tables: an audit for each, and one for the
    turns inserted at the end."""
    ways = {0: (0, None)}
    for t in [*tables, None]:
        after = {}
        for entry, (cost, chain) in ways.items():
            exits = {0: _closing(entry)} if t is None else t[entry]
            for leave, (more, audit) in exits.items():
                way = (cost + more, (chain, audit))
                known = after.get(leave)
                if known is None or way[0] < known[0] or way[0] == known[0] and _less(way[1], known[1]):
                    after[leave] = way
        ways = after
    cost, chain = ways[0]
    audits = []
    while chain is not None:
        chain, audit = chain
        audits.append(audit)
    return cost, audits[::-1]


def edited(stack, audit, turns):
    """Carry out an audit: yields (edit, role, text) for each turn left or put in; returns the stack
    behind it. `turns` holds (role, text)."""
    turns = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            stack = shifted(stack, role[:1])
        else:
            terminal = next(t for t in NAMES if shifted(stack, t))
            stack, role = shifted(stack, terminal), NAMES[terminal]
        yield edit, role, text
    return stack
