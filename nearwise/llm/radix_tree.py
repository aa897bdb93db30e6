"""An adaptive radix tree over byte keys: nodes grow from 4 to 16, 48 and 256 children, single ways are compressed."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark import cloudpickle


class Node:
    """A branching point. ``prefix`` holds the bytes between the branch above and this one; ``total`` what lies below.

    Up to 4 and up to 16 children are held beside their sorted bytes, up to 48 through an index of 256 bytes, and more
    directly.
    """

    __slots__ = ("prefix", "total", "room", "index", "children")

    def __init__(self, prefix: bytes, total):
        self.prefix, self.total = prefix, total
        self.room, self.index, self.children = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = bisect_left(self.index, byte)
            return self.children[at] if at < len(self.index) and self.index[at] == byte else None
        if self.room == 48:
            slot = self.index[byte]
            return self.children[slot - 1] if slot else None
        return self.children[byte]

    def add(self, byte: int, node: Node) -> None:
        """Put a new child under a byte that has none yet, in the next larger layout if this one is full."""
        if self.room <= 16 and len(self.children) == self.room:
            if self.room == 4:
                self.room = 16
            else:
                index = bytearray(256)
                for slot, held in enumerate(self.index, 1):
                    index[held] = slot
                self.room, self.index = 48, index
        elif self.room == 48 and len(self.children) == 48:
            direct = [None] * 256
            for held, slot in enumerate(self.index):
                if slot:
                    direct[held] = self.children[slot - 1]
            self.room, self.index, self.children = 256, None, direct
        if self.room <= 16:
            at = bisect_left(self.index, byte)
            self.index.insert(at, byte)
            self.children.insert(at, node)
        elif self.room == 48:
            self.children.append(node)
            self.index[byte] = len(self.children)
        else:
            self.children[byte] = node

    def in_order(self) -> Iterator[Node]:
        """The children by ascending byte."""
        if self.room <= 16:
            yield from self.children
        elif self.room == 48:
            yield from (self.children[slot - 1] for slot in self.index if slot)
        else:
            yield from (node for node in self.children if node is not None)


class RadixTree:
    """Keys with totals: every node's total is that of all keys that pass through it or end at it.

    ``add(total, other)`` adds a key's total to a node's in place; ``copy(total)`` makes one of its own. A key may be the
    beginning of another, and may come again.
    """

    def __init__(self, add: Callable, copy: Callable):
        self.add, self.copy, self.root = add, copy, None

    def insert(self, key: bytes, total) -> None:
        if self.root is None:
            self.root = Node(b"", self.copy(total))
        else:
            self.add(self.root.total, total)
        node, at, size = self.root, 0, len(key)
        while at < size:
            byte = key[at]
            below = node.child(byte)
            if below is None:
                node.add(byte, Node(key[at + 1 :], self.copy(total)))
                return
            at += 1
            prefix = below.prefix
            if key.startswith(prefix, at):
                self.add(below.total, total)
                node, at = below, at + len(prefix)
                continue
            shared = next((i for i, (a, b) in enumerate(zip(prefix, key[at:])) if a != b), min(len(prefix), size - at))
            upper = Node(prefix[:shared], self.copy(below.total))
            self.add(upper.total, total)
            upper.add(prefix[shared], below)
            below.prefix = prefix[shared + 1 :]
            self._replace(node, byte, upper)
            if at + shared < size:
                upper.add(key[at + shared], Node(key[at + shared + 1 :], self.copy(total)))
            return

    @staticmethod
    def _replace(node: Node, byte: int, child: Node) -> None:
        if node.room <= 16:
            node.children[bisect_left(node.index, byte)] = child
        elif node.room == 48:
            node.children[node.index[byte] - 1] = child
        else:
            node.children[byte] = child

    def aligned(self, width: int) -> Iterator[tuple[int, object]]:
        """Depth in units of ``width`` bytes, and total, of every place in the tree at a multiple of ``width`` bytes.

        Such places also lie inside compressed ways; they have the total of the node at the way's end. The root comes first.
        """
        if self.root is None:
            return
        yield 0, self.root.total
        stack = [(self.root, 0)]
        while stack:
            node, end = stack.pop()
            for below in node.in_order():
                stop = end + 1 + len(below.prefix)
                for depth in range(end // width + 1, stop // width + 1):
                    yield depth, below.total
                stack.append((below, stop))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
