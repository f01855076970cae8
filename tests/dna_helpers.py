"""Deterministic sequences of the tests."""


def lcg32(n: int, state: int) -> str:
    out = []
    for _ in range(n):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append("ACGT"[state >> 30])
    return "".join(out)


def pseudo_dna(n: int, state: int) -> str:
    out = []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1) % 2**64
        out.append("ACGT"[(state >> 32) & 3])
    return "".join(out)


def rc(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
