"""Replay of one resource's log record by record over a tree: what the distributed replay must equal."""

from collections.abc import Iterator

import pandas as pd

from tallyforge import schema


class Tree:
    """Objects by path as nested folders, so that a folder moves or goes as one node."""

    def __init__(self) -> None:
        self.root: dict = {}

    def _folder(self, parts: list[str], make: bool = False) -> dict | None:
        at = self.root
        for p in parts:
            below = at.get(p)
            if below is None:
                if not make:
                    return None
                below = at[p] = [None, {}]
            at = below[1]
        return at

    def node(self, path: str) -> list | None:
        *above, name = path.split("/")
        folder = self._folder(above)
        return None if folder is None else folder.get(name)

    def put(self, path: str, value: tuple) -> None:
        *above, name = path.split("/")
        self._folder(above, True).setdefault(name, [None, {}])[0] = value

    def take(self, path: str) -> list | None:
        *above, name = path.split("/")
        folder = self._folder(above)
        return None if folder is None else folder.pop(name, None)

    def add(self, path: str, node: list) -> None:
        """A taken node goes in at ``path``; what it brings replaces what is there."""
        *above, name = path.split("/")
        into = self._folder(above, True).setdefault(name, [None, {}])
        todo = [(into, node)]
        while todo:
            old, new = todo.pop()
            old[0] = old[0] if new[0] is None else new[0]
            for k, child in new[1].items():
                if k in old[1]:
                    todo.append((old[1][k], child))
                else:
                    old[1][k] = child

    def objects(self) -> Iterator[tuple[str, tuple]]:
        todo = [("", self.root)]
        while todo:
            prefix, folder = todo.pop()
            for name, (value, below) in folder.items():
                if value is not None:
                    yield prefix + name, value
                todo.append((f"{prefix}{name}/", below))


def _holds_any(node: list | None) -> bool:
    todo = [] if node is None else [node]
    while todo:
        value, below = todo.pop()
        if value is not None:
            return True
        todo += below.values()
    return False


def apply(records: pd.DataFrame) -> Iterator[tuple]:
    """(path, mode, content, size, applied, error) of what is left after all records of one resource."""
    tree, applied, error = Tree(), 0, None
    for r in records.sort_values("seq", kind="stable").itertuples():
        if r.kind not in schema.KINDS:
            error = f"unknown kind {r.kind}"
        elif r.kind in ("create", "write", "truncate"):
            if r.offset:
                error = "range writes are not supported"
            else:
                tree.put(r.path, (int(r.mode) or 0o644, r.content_hash, int(r.size)))
        elif r.kind == "delete":
            tree.take(r.path)
        elif r.kind == "chmod":
            node = tree.node(r.path)
            if node is not None and node[0] is not None:
                node[0] = (int(r.mode) or 0o644, *node[0][1:])
            else:
                error = f"no such path {r.path}"
        elif not _holds_any(tree.node(r.path)):
            error = f"no such path {r.path}"
        elif r.path != r.dest_path:
            tree.add(r.dest_path, tree.take(r.path))
        if error:
            break
        applied += 1
    state = sorted(tree.objects())
    for path, (mode, content, size) in state:
        yield path, mode, content, size, applied, error
    if not state:
        yield None, None, None, None, applied, error
