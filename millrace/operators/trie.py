"""The template trie: which template a message has.

A template matches a message by itself, whatever other templates there are:

1. Constant characters are equal.
2. A wildcard at the end of the template covers the rest of the message.
3. Before a mark (a character that is no letter or digit) a wildcard ends at the first
   place of that mark. ``prepared`` spreads a wildcard whose content held the mark.
4. Before a letter or digit a wildcard ends at any place of it.

Of several matching templates the first in trie order holds: at each place constants come
before wildcards, and of those the one that ends first. Of equal templates the last
inserted holds. So inserting a template never takes a match from a message, and a
message is found right after a template fitted to it is inserted.

The trie is built on the driver from a template dimension and immutable while it matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from millrace.functions.align import WILD

_CONSTANT = re.compile("[^<>* ]")


@dataclass
class Node:
    """What follows a common beginning: constants by their first character, and wildcards by what ends them.

    ``constants`` leads from a character to the run that begins with it and the node behind the run.
    ``wilds`` leads from the character after a wildcard, or "" at a template's end, to
    the node at that character.
    """

    constants: dict[str, tuple[str, Node]] = field(default_factory=dict)
    wilds: dict[str, Node] = field(default_factory=dict)
    cid: int | None = None

    def after(self, message: str, at: int) -> Iterator[tuple[Node, int]]:
        """The nodes that can follow at a place of a message, and where each goes on; the preferred first."""
        run, node = self.constants.get(message[at], ("", None))
        if node is not None and message.startswith(run, at):
            yield node, at + len(run)
        ends = []
        for stop, node in self.wilds.items():
            place = message.find(stop, at) if stop else len(message)
            while place >= 0:
                ends.append((place, len(ends), node))
                place = message.find(stop, place + 1) if stop.isalnum() else -1
        for place, _, node in sorted(ends, key=lambda e: e[:2]):
            yield node, place


class Trie:
    """Templates by their text; ``find`` gives the id of the first that matches, in trie order."""

    def __init__(self) -> None:
        self.root = Node()

    def find(self, message: str) -> int | None:
        """Depth first; what failed at a place is not tried there again."""
        todo, failed = [iter([(self.root, 0)])], set()
        while todo:
            node, at = next(todo[-1], (None, 0))
            if node is None:
                todo.pop()
            elif at == len(message):
                if node.cid is not None:
                    return node.cid
            elif (id(node), at) not in failed:
                failed.add((id(node), at))
                todo.append(node.after(message, at))
        return None

    def insert(self, template: str, contents: list[str], cid: int) -> None:
        """Add a template with the contents its wildcards had; one without any constant is not added."""
        units, _ = prepared(template, contents)
        units = [u for u, before in zip(units, ["", *units], strict=False) if u != WILD or before != WILD]
        if not _CONSTANT.search("".join(units)):
            return
        node, run = self.root, ""
        for unit, following in zip(units, [*units[1:], ""], strict=True):
            if unit == WILD:
                node = self._behind(node, run).wilds.setdefault(following, Node())
                run = ""
            else:
                run += unit
        self._behind(node, run).cid = cid

    @staticmethod
    def _behind(node: Node, run: str) -> Node:
        """The node behind a run of constants, cut in or added where it is missing."""
        while run:
            known, child = node.constants.get(run[0], (run, None))
            same = next((k for k, (x, y) in enumerate(zip(known, run, strict=False)) if x != y), min(len(known), len(run)))
            if child is None:
                child = Node()
                node.constants[run[0]] = (run, child)
            elif same < len(known):
                child = Node(constants={known[same]: (known[same:], child)})
                node.constants[run[0]] = (known[:same], child)
            node, run = child, run[same:]
        return node


def prepared(template: str, contents: list[str]) -> tuple[list[str], list[str]]:
    """Units and contents as they enter the trie.

    A wildcard whose content holds the mark that follows it is spread over that mark;
    one that covers nothing goes. A first token that begins with a wildcard is that
    wildcard alone, with the token's whole text as content, and then so is the second.
    """
    pieces, kept = _spread(template.split(WILD), [*contents, *[""] * template.count(WILD)])
    covered = [bool(c) for c in kept]
    out = pieces[0] + "".join(WILD * c + p for c, p in zip(covered, pieces[1:], strict=True))
    kept, out = [c for c in kept if c], out.strip()
    for place in (0, 1):
        tokens = out.split(" ")
        if not tokens[0].startswith(WILD) or place >= len(tokens) or len(kept) <= place:
            break
        token = tokens[place]
        if token.startswith(WILD) and token != WILD:
            held = token.count(WILD)
            filled = iter(kept[place : place + held])
            kept[place : place + held] = [re.sub(r"<\*>", lambda _: next(filled, ""), token)]
            tokens[place] = WILD
            out = " ".join(tokens)
    pieces, kept = _spread(out.split(WILD), [*kept, *[""] * out.count(WILD)])
    return _units(WILD.join(pieces)), kept


def _spread(pieces: list[str], contents: list[str]) -> tuple[list[str], list[str]]:
    """The constants around wildcards, and the contents, with wildcards spread over the marks that follow them."""
    out, kept = pieces[:1], []
    for content, after in zip(contents, pieces[1:], strict=False):
        mark = after[:1]
        parts = content.split(mark) if mark and not mark.isalnum() else [content]
        out += [mark] * (len(parts) - 1) + [after]
        kept += parts
    return out, kept


def _units(template: str) -> list[str]:
    return re.findall(r"(?s)<\*>|.", template)


def build(rows: list[tuple[int, str, list[str]]]) -> Trie:
    """A trie of (cid, template, contents) rows, inserted in order."""
    trie = Trie()
    for cid, template, contents in rows:
        trie.insert(template, contents, cid)
    return trie
