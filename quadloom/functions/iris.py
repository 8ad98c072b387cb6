"""Resolving relative IRIs against a base, on the driver's side and as a column expression (RFC 3986, section 5.2)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B).
PARTS = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _undotted(path: str) -> str:
    kept: list[str] = []
    for segment in path.split("/"):
        if segment == "..":
            del kept[max(1, len(kept) - 1) :]
        elif segment != ".":
            kept.append(segment)
    return "/".join(kept) + ("/" if path.endswith(("/.", "/..")) else "")


def _around(base: str) -> tuple[str, str, str, str]:
    """Of a base: its scheme, scheme and authority, folder and everything up to the query."""
    scheme, authority, path, query, _ = PARTS.match(base).groups()
    head = f"{scheme}:" if scheme else ""
    root = head + (f"//{authority}" if authority is not None else "")
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else "/" if authority is not None else ""
    return head, root, folder, path + (f"?{query}" if query is not None else "")


def resolve(base: str, reference: str) -> str:
    """reference as an absolute IRI; unchanged without a base."""
    if not base or re.match(SCHEME, reference):
        return reference
    head, root, folder, whole = _around(base)
    if not reference or reference[0] == "#":
        return root + whole + reference
    if reference.startswith("//"):
        return head + reference
    path, tail = re.match(r"([^?#]*)(.*)", reference, re.S).groups()
    if not path:
        return root + whole.split("?")[0] + tail
    return root + _undotted(path if path[0] == "/" else folder + path) + tail


def resolved(reference: Column, base: str) -> Column:
    """As resolve, for a column of references and one base."""
    if not base:
        return reference
    head, root, folder, whole = _around(base)
    path, tail = (F.regexp_extract(reference, r"(?s)^([^?#]*)(.*)$", k) for k in (1, 2))
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(folder), path))

    def fold(kept: Column, segment: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.lit(1), F.size(kept) - 1))
        return F.when(segment == "..", shorter).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), fold)
    undotted = F.concat(F.array_join(kept, "/"), F.when(full.rlike(r"/\.\.?$"), "/").otherwise(""))
    return (
        F.when(reference.rlike(SCHEME), reference).when((reference == "") | F.startswith(reference, F.lit("#")), F.concat(F.lit(root + whole), reference))
        .when(F.startswith(reference, F.lit("//")), F.concat(F.lit(head), reference)).when(path == "", F.concat(F.lit(root + whole.split("?")[0]), tail))
        .otherwise(F.concat(F.lit(root), undotted, tail))
    )
