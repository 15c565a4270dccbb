"""Integer formulas of raster prediction and colour, as SQL text that Spark and other engines read alike.

W, N, NW, NE, WW and NN are a sample's neighbours, M the highest sample value. All arithmetic is whole; >> rounds down.
"""

from __future__ import annotations

import re


def spark(text: str) -> str:
    """The same formula in Spark's SQL, where whole division is div."""
    return text.replace("//", " div ")


def named(text: str, **values: object) -> str:
    """A formula with other names or constants in place of its symbols."""
    return re.sub(r"\b(" + "|".join(values) + r")\b", lambda m: str(values[m[1]]), text) if values else text


def clamp(text: str) -> str:
    return f"greatest(0, least(M, {text}))"


MED = "CASE WHEN NW >= greatest(W, N) THEN least(W, N) WHEN NW <= least(W, N) THEN greatest(W, N) ELSE N + W - NW END"
_P = "(W + N - NW)"
PAETH = f"CASE WHEN abs({_P} - W) <= abs({_P} - N) AND abs({_P} - W) <= abs({_P} - NW) THEN W WHEN abs({_P} - N) <= abs({_P} - NW) THEN N ELSE NW END"
DH, DV = "(abs(W - WW) + abs(N - NW) + abs(NE - N))", "(abs(W - NW) + abs(N - NN) + abs(NE - N))"
_D, _Q = f"({DV} - {DH})", "(((W + N) >> 1) + ((NE - NW) >> 2))"
GAP = clamp(
    f"CASE WHEN {_D} > 80 THEN W WHEN {_D} < -80 THEN N WHEN {_D} > 32 THEN (({_Q} + W) >> 1) WHEN {_D} > 8 THEN ((3 * {_Q} + W) >> 2)"
    f" WHEN {_D} < -32 THEN (({_Q} + N) >> 1) WHEN {_D} < -8 THEN ((3 * {_Q} + N) >> 2) ELSE {_Q} END"
)
_EDGE = "(abs(W - N) + abs(W - NW) + abs(N - NW))"
RULE = (
    f"CASE WHEN {_EDGE} <= greatest(4, M >> 5) THEN ((W + N + 1) >> 1) WHEN {DH} + greatest(8, M >> 4) < {DV} THEN W"
    f" WHEN {DV} + greatest(8, M >> 4) < {DH} THEN N WHEN {_EDGE} >= (M >> 1) THEN {PAETH} ELSE {GAP} END"
)
#: The averages that both predictor families draw on, by their weights.
_AVERAGE = "((W + N + 1) >> 1)"
_RIGHT = "((W + NE + 1) >> 1)"


def _quarter(text: str) -> str:
    return clamp(f"(({text} + 2) >> 2)")


def _half(text: str) -> str:
    return clamp(f"(({text} + 1) >> 1)")


#: Predictors by number, first family.
PREDICT_X = [
    MED, "W", "N", _AVERAGE, clamp("N + W - NW"), "NE", _RIGHT, _quarter("3 * (W + N) - 2 * NW"),
    clamp("2 * W - WW"), clamp("2 * N - NN"), _half("2 * W - WW + 2 * N - NN"), clamp("W + ((N - NW) >> 1)"), clamp("N + ((W - NW) >> 1)"),
    _quarter("4 * W + 2 * N - 3 * NW + NE"), _quarter("W + 2 * N + NE"), _quarter("3 * W + N"), _quarter("W + 3 * N"),
    _quarter("5 * N + 2 * W - 3 * NW + NE"), _half("2 * W + N - NW"), _half("W + 2 * N - NW"), clamp("W + ((NE - NW) >> 1)"), clamp("N + ((NE - NW) >> 1)"),
    clamp("(W + N + NE + 1) // 3"), _quarter("2 * W + N + NE"), _quarter("W + 2 * N + NW"), _quarter("3 * W + 3 * N - 2 * NW"),
    _quarter("4 * N + W - 2 * NW + NE"), _quarter("4 * W + N - 2 * NW + NE"), _half("W + N + NE - NW"),
    _quarter("6 * W + 2 * N - 5 * NW + NE"), _quarter("2 * W + 6 * N - 5 * NW + NE"), _quarter("2 * W + 6 * N - 5 * NW + NE"),
]
#: Predictors by number, second family.
PREDICT_A = [
    MED, PAETH, "W", "N", _AVERAGE, clamp("N + W - NW"), "NE", _RIGHT, "((N + NE + 1) >> 1)", clamp("2 * W - WW"), clamp("2 * N - NN"),
    clamp("W + ((3 * (N - NW)) >> 2)"), clamp("N + ((3 * (W - NW)) >> 2)"), GAP, _quarter("W + N + NE + NW"), _quarter("5 * W + 2 * N - 3 * NW + NE"),
    _quarter("W + 3 * N"), _quarter("3 * W + N"), _quarter("5 * N + 2 * W - 3 * NW + NE"), _half("2 * W + N - NW"), _half("W + 2 * N - NW"),
    clamp("W + ((NE - NW) >> 1)"), clamp("N + ((NE - NW) >> 1)"), clamp("(W + N + NE + 1) // 3"), _quarter("2 * W + N + NE"), _quarter("W + 2 * N + NW"),
    _quarter("3 * W + 3 * N - 2 * NW"), _quarter("4 * N + W - 2 * NW + NE"), _quarter("4 * W + N - 2 * NW + NE"), _half("W + N + NE - NW"),
    _quarter("6 * W + 2 * N - 5 * NW + NE"), _quarter("2 * W + 6 * N - 5 * NW + NE"),
]
PREDICT_BASE = PREDICT_X[:8]


def residual(value: str, prediction: str) -> str:
    """Wrapped to the signed range of M + 1 values."""
    return f"((({value} - ({prediction}) + ((M + 1) >> 1)) & M) - ((M + 1) >> 1))"


def bits(text: str, most: int = 16) -> str:
    """Length of a whole number in bits."""
    return "CASE " + " ".join(f"WHEN {text} < {1 << k} THEN {k}" for k in range(most)) + f" ELSE {most} END"


def cost(text: str, extra: int = 1) -> str:
    """Cost of a residual's size: 1 for 0, else twice its bits plus `extra`."""
    return f"(CASE WHEN {text} = 0 THEN 1 ELSE 2 * ({bits(text, 10)}) + {extra} END)"


#: Weights of red in the third plane, transforms 11 to 28 and 29 to 34.
BLEND = [8, 16, 24, 40, 48, 56, 64, 12, 20, 28, 18, 22, 26, 19, 21, 23, 25, 27]
LUMA_BLEND = [0, 16, 20, 22, 24, 32]


def transform(t: int) -> tuple[str, str, str]:
    """The three planes of colour transform t, from r, g and b; the last two biased by 256 but for t = 0."""
    co, y = "(r - b)", "(b + ((r - b) >> 1))"
    simple = {
        0: ("r", "g", "b"), 1: ("g", "r - g", "b - g"), 2: (f"({y} + ((g - {y}) >> 1))", co, f"(g - {y})"), 3: ("r", "g - r", "b - r"), 4: ("b", "r - b", "g - b"),
        5: ("g", "r - g", "b - ((r + g) >> 1)"), 6: ("g", "b - g", "r - ((b + g) >> 1)"), 7: ("r", "b - r", "g - ((r + b) >> 1)"), 8: ("b", "r - b", "g - ((r + b) >> 1)"),
        9: ("r", "g - r", "b - g"), 10: ("b", "g - b", "r - g"), 35: ("r", "g - r", "b - ((g + r) >> 1)"),
    }
    if t in simple:
        a, b, c = simple[t]
    else:
        w = BLEND[t - 11] if t <= 28 else LUMA_BLEND[t - 29]
        a = "g" if t <= 28 else "(g + ((r - g + b - g) >> 2))"
        b, c = "r - g", f"b - ((({w} * r) + {64 - w} * g) >> 6)"
    return (a, b, c) if t == 0 else (a, f"({b}) + 256", f"({c}) + 256")


def inverse(t: int) -> tuple[str, str, str]:
    """Red, green and blue from planes p, q and s."""
    q, s = "(q - 256)", "(s - 256)"
    if t == 0:
        return "p", "q", "s"
    if t == 2:
        y = f"(p - ({s} >> 1))"
        b = f"({y} - ({q} >> 1))"
        return f"({b} + {q})", f"({s} + {y})", b
    named_ = {
        1: (f"p + {q}", "p", f"p + {s}"), 3: ("p", f"p + {q}", f"p + {s}"), 4: (f"p + {q}", f"p + {s}", "p"), 5: (f"p + {q}", "p", f"{s} + ((p + {q} + p) >> 1)"),
        6: (f"{s} + ((p + {q} + p) >> 1)", "p", f"p + {q}"), 7: ("p", f"{s} + ((p + p + {q}) >> 1)", f"p + {q}"), 8: (f"p + {q}", f"{s} + ((p + {q} + p) >> 1)", "p"),
        9: ("p", f"p + {q}", f"{s} + p + {q}"), 10: (f"{s} + p + {q}", f"p + {q}", "p"), 35: ("p", f"p + {q}", f"{s} + ((p + {q} + p) >> 1)"),
    }
    if t in named_:
        return named_[t]
    if t <= 28:
        w = BLEND[t - 11]
        return f"p + {q}", "p", f"{s} + ((({w} * (p + {q})) + {64 - w} * p) >> 6)"
    w = LUMA_BLEND[t - 29]
    v = f"({s} + (({w} * {q}) >> 6))"  # blue above green
    g = f"(p - (({q} + {v}) >> 2))"
    return f"{g} + {q}", g, f"{g} + {v}"


def python(text: str) -> str:
    """A formula as a Python expression, for kernels that go sample by sample."""
    tokens = re.findall(r"CASE|WHEN|THEN|ELSE|END|\w+|//|>>|<=|>=|<>|.", text)
    at = 0

    def upto(*stops: str) -> str:
        nonlocal at
        out, depth = [], 0
        while tokens[at] not in stops or depth:
            if tokens[at] == "CASE":
                out.append(case())
                continue
            depth += {"(": 1, ")": -1}.get(tokens[at], 0)
            out.append({"greatest": "max", "least": "min", "AND": "and", "OR": "or", "=": "==", "<>": "!="}.get(tokens[at], tokens[at]))
            at += 1
        at += 1
        return "".join(out).strip()

    def case() -> str:
        nonlocal at
        at += 1
        while tokens[at] == " ":
            at += 1
        out = []
        while tokens[at] == "WHEN":
            at += 1
            test, value = upto("THEN"), upto("WHEN", "ELSE")
            out.append(f"({value}) if ({test}) else ")
            if tokens[at - 1] == "ELSE":
                last = upto("END")
                return "(" + "".join(out) + f"({last}))"
            at -= 1
        raise ValueError("a CASE without ELSE")

    tokens.append("")
    return upto("")
