"""Adaptive radix trees over byte keys: inner nodes grow through four layouts, and bytes without a branch are one prefix.

Layouts: up to 4 and up to 16 children as sorted bytes with a list beside them, up to 48 as 256 slots of indices into a list,
and 256 direct slots. A key may end where another goes on, so every node can hold a value itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import Any

_NONE = 255


class Node:
    """prefix: the bytes from the parent's branch to this node's; value: of the key that ends here, or None."""

    __slots__ = ("children", "prefix", "slots", "value")

    def __init__(self, prefix: bytes, value: Any = None):
        self.prefix, self.value = prefix, value
        self.slots: bytearray | None = bytearray()
        self.children: list[Node | None] = []

    @property
    def layout(self) -> int:
        if self.slots is None:
            return 256
        if len(self.slots) == 256:
            return 48
        return 4 if len(self.slots) <= 4 else 16

    def find(self, byte: int) -> Node | None:
        slots = self.slots
        if slots is None:
            return self.children[byte]
        if len(slots) == 256:
            at = slots[byte]
            return None if at == _NONE else self.children[at]
        at = bisect_left(slots, byte)
        return self.children[at] if at < len(slots) and slots[at] == byte else None

    def put(self, byte: int, child: Node) -> None:
        """Sets the child under ``byte``; the layout grows where it is full."""
        slots = self.slots
        if slots is None:
            self.children[byte] = child
        elif len(slots) == 256:
            if slots[byte] != _NONE:
                self.children[slots[byte]] = child
            elif len(self.children) < 48:
                slots[byte] = len(self.children)
                self.children.append(child)
            else:
                wide: list[Node | None] = [None] * 256
                for b in range(256):
                    if slots[b] != _NONE:
                        wide[b] = self.children[slots[b]]
                wide[byte] = child
                self.slots, self.children = None, wide
        else:
            at = bisect_left(slots, byte)
            if at < len(slots) and slots[at] == byte:
                self.children[at] = child
            elif len(slots) < 16:
                insort(slots, byte)
                self.children.insert(at, child)
            else:
                index = bytearray([_NONE]) * 256
                for i, b in enumerate(slots):
                    index[b] = i
                self.slots = index
                self.put(byte, child)

    def in_order(self) -> Iterator[Node]:
        slots = self.slots
        if slots is not None and len(slots) == 256:
            return (self.children[i] for i in slots if i != _NONE)
        return (c for c in self.children if c is not None)


def insert(root: Node, key: bytes) -> Node:
    """The node where ``key`` ends, made where there is none. The root has an empty prefix."""
    node, at = root, 0
    while at < len(key):
        child = node.find(key[at])
        if child is None:
            new = Node(key[at:])
            node.put(key[at], new)
            return new
        prefix, n = child.prefix, len(child.prefix)
        if key.startswith(prefix, at):
            node, at = child, at + n
            continue
        same, most = 1, min(n, len(key) - at)
        while same < most and prefix[same] == key[at + same]:
            same += 1
        branch = Node(prefix[:same])
        child.prefix = prefix[same:]
        branch.put(child.prefix[0], child)
        node.put(key[at], branch)
        node, at = branch, at + same
    return node


def walk(root: Node) -> Iterator[tuple[int, Node]]:
    """(bytes that a node shares with the one before it in key order, the node) for every node with a value, in key order.

    Shared bytes are those up to the branch where the two part; 0 for the first.
    """
    stack: list[tuple[int, int, Node]] = [(0, 0, root)]  # bytes shared with what came before, bytes above the node, node
    while stack:
        shared, above, node = stack.pop()
        end = above + len(node.prefix)
        if node.value is not None:
            yield shared, node
            shared = end
        below = list(node.in_order())
        stack.extend((end if i else shared, end, c) for i, c in reversed(list(enumerate(below))))
