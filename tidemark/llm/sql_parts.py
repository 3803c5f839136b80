"""Pieces of DuckDB SQL that several of the queries' oracles share."""
from __future__ import annotations

from collections.abc import Sequence

#: The reversed polynomial of CRC-32 (fixed value of the standard).
CRC_POLYNOMIAL = 3988292384


def crc_table() -> str:
    """CTEs ``tab0`` to ``tab8`` and ``tab(t)``: the list of the 256 checksums of single bytes."""
    steps = ["tab0 AS (SELECT unnest(range(256)) AS i, unnest(range(256)) AS c)"]
    steps += [f"tab{k + 1} AS (SELECT i, xor(c >> 1, (c & 1) * {CRC_POLYNOMIAL}) AS c FROM tab{k})" for k in range(8)]
    return ",\n".join([*steps, "tab AS (SELECT list(c ORDER BY i) AS t FROM tab8)"])


def crc32(text: str) -> str:
    """The unsigned checksum of a text's UTF-8 bytes; ``t`` of ``tab`` must be in scope."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


def hilbert(source: str, axes: Sequence[str], bits: int) -> str:
    """CTEs that start from ``source`` and end in ``curved``: its columns with the place ``curve`` on the Hilbert curve of ``axes``."""
    n, at, steps = len(axes), 0, [f"h0 AS (SELECT *, {', '.join(f'{a}::BIGINT AS x{i}' for i, a in enumerate(axes))} FROM {source})"]

    def step(**new: str) -> None:
        nonlocal at
        steps.append(f"h{at + 1} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in new.items())}) FROM h{at})")
        at += 1

    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            here = f"((x{i} >> {bit}) & 1) = 1"
            if i == 0:
                step(x0=f"CASE WHEN {here} THEN xor(x0, {low}) ELSE x0 END")
            else:
                swap = f"(xor(x0, x{i}) & {low})"
                step(**{"x0": f"CASE WHEN {here} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END", f"x{i}": f"CASE WHEN {here} THEN x{i} ELSE xor(x{i}, {swap}) END"})
    for i in range(1, n):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    flip = "0"
    for bit in range(bits - 1, 0, -1):
        flip = f"xor({flip}, ((x{n - 1} >> {bit}) & 1) * {(1 << bit) - 1})"
    steps.append(f"flipped AS (SELECT *, {flip} AS flip FROM h{at})")
    parts = [f"(((xor(x{i}, flip) >> {bit}) & 1) << {bit * n + n - 1 - i})" for bit in range(bits) for i in range(n)]
    steps.append(f"curved AS (SELECT *, {' + '.join(parts)} AS curve FROM flipped)")
    return ",\n".join(steps)
