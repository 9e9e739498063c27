"""A byte machine: ten registers, an accumulator, 4-byte instructions, saturating arithmetic.

Operand forms: one register works on the accumulator, two store into the first, three into the third."""

from __future__ import annotations

import functools
import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = ("HLT", "CLR", "INC", "DEC", "SHL", "SHR", "ROL", "ROR", "NOT", "PUSH", "POP", "LOADI", "SWAP", "ADD", "SUB", "MUL", "DIV", "AND", "OR", "XOR", "MOV")
REGISTERS, MEMORY, STATE = "ABCDEFGHIJ", 1024, 16
_UNARY = {
    "CLR": lambda v: 0,
    "INC": lambda v: min(v + 1, 255),
    "DEC": lambda v: max(v - 1, 0),
    "SHL": lambda v: v << 1 & 255,
    "SHR": lambda v: v >> 1,
    "ROL": lambda v: (v << 1 | v >> 7) & 255,
    "ROR": lambda v: (v >> 1 | v << 7) & 255,
    "NOT": lambda v: ~v & 255,
}
_BINARY = {
    "ADD": lambda a, b: min(a + b, 255),
    "SUB": lambda a, b: max(a - b, 0),
    "MUL": lambda a, b: min(a * b, 255),
    "DIV": lambda a, b: a // b if b else 255,
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
    "XOR": lambda a, b: a ^ b,
}
FORMS = {**{k: (0, 1) for k in _UNARY}, "PUSH": (1,), "POP": (1,), "LOADI": (1,), "SWAP": (1, 2), **{k: (1, 2, 3) for k in _BINARY}, "MOV": (2,)}


def assemble(line: str) -> tuple[int, int, int, int]:
    op, *args = line.split()
    v = [int(a) if op == "LOADI" else REGISTERS.index(a) + 1 for a in args]
    return (OPS.index(op), *v, *[0] * (3 - len(v)))


def disassemble(code: tuple[int, int, int, int]) -> str:
    op = OPS[code[0]]
    return " ".join([op, *([str(code[1])] if op == "LOADI" else [REGISTERS[a - 1] for a in code[1:] if a])])


def execute(code: tuple[int, ...], acc: int, regs: list[int]) -> int:
    """The accumulator after the instruction; regs is changed in place."""
    op, (a, b, c) = OPS[code[0]], code[1:]
    if op in _UNARY:
        if not a:
            return _UNARY[op](acc)
        regs[a - 1] = _UNARY[op](regs[a - 1])
    elif op == "PUSH":
        return regs[a - 1]
    elif op == "POP":
        regs[a - 1] = acc
    elif op == "LOADI":
        return a
    elif op == "SWAP" and not b:
        acc, regs[a - 1] = regs[a - 1], acc
    elif op == "SWAP":
        regs[a - 1], regs[b - 1] = regs[b - 1], regs[a - 1]
    elif op == "MOV":
        regs[a - 1] = regs[b - 1]
    elif not b:
        return _BINARY[op](acc, regs[a - 1])
    else:
        regs[(c or a) - 1] = _BINARY[op](regs[a - 1], regs[b - 1])
    return acc


def run(program: list[str], acc: int = 0, regs: list[int] | None = None) -> bytes:
    """Memory, then the state at first and after each fetch: counter, accumulator, instruction, registers."""
    if 4 * len(program) > MEMORY:
        raise ValueError("the program doesn't fit into memory")
    regs, pc, code = list(regs or [0] * len(REGISTERS)), 0, (0, 0, 0, 0)
    memory = b"".join(bytes(assemble(x)) for x in program).ljust(MEMORY, b"\0")
    out = bytearray(memory) + bytes((pc, acc, *code, *regs))
    while True:
        code = tuple(memory[pc * 4 : pc * 4 + 4])
        pc = min(pc + 1, MEMORY // 4 - 1)
        out += bytes((pc, acc, *code, *regs))
        if code[0] == 0:
            return bytes(out)
        acc = execute(code, acc, regs)


def random_program(seed: int, length: int) -> list[str]:
    rng, names, out = random.Random(seed), sorted(FORMS), []
    for _ in range(length - 1):
        op = rng.choice(names)
        out.append(f"LOADI {rng.randint(0, 255)}" if op == "LOADI" else " ".join([op, *(rng.choice(REGISTERS) for _ in range(rng.choice(FORMS[op])))]))
    return [*out, "HLT"]


def _generate(longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for seed in batch.column("id").to_pylist():
            rng = random.Random(~seed)
            p = random_program(seed, rng.randint(2, longest))
            data = run(p, rng.randint(0, 255), [rng.randint(0, 255) for _ in REGISTERS])
            rows.append((hashlib.md5("".join(p).encode()).hexdigest(), "\n".join(p), (len(data) - MEMORY) // STATE, data))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["name", "program", "n_states", "states"])


def generate(spark: SparkSession, n: int, longest: int = 255) -> DataFrame:
    """n seeded programs with their states; equal programs have equal names and the first stays."""
    return spark.range(n).mapInArrow(functools.partial(_generate, longest), "name string, program string, n_states int, states binary").dropDuplicates(["name"])


def accuracy(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """(name, matched, total) of states by name; a byte that the prediction lacks counts once as wrong."""
    pairs = true.select("name", F.col("states").alias("t")).join(predicted.select("name", F.col("states").alias("p")), "name", "left")
    at = lambda c: F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0))
    same = F.size(F.filter(F.arrays_zip(at("t").alias("a"), F.coalesce(at("p"), F.array().cast("array<string>")).alias("b")), lambda x: x["a"] == x["b"]))
    return pairs.select("name", same.alias("matched"), F.octet_length("t").alias("total"))
