"""Plain mathematics to and from LaTeX, over Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_spaces, strip

#: Characters and their LaTeX.
SYMBOLS = {
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx",
    "→": r"\rightarrow", "←": r"\leftarrow", "⇌": r"\rightleftharpoons", "⇋": r"\rightleftharpoons", "↔": r"\leftrightarrow",
    "∞": r"\infty", "√": r"\sqrt{}", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∆": r"\Delta", "∇": r"\nabla",
    "°": r"^{\circ}", "·": r"\cdot", "∈": r"\in", "∉": r"\notin", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta",
    "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau",
    "φ": r"\phi", "ω": r"\omega", "Ω": r"\Omega", "Σ": r"\Sigma",
}
_HINT = r"[=<>≤≥≠≈+×÷±√∑∫∞→⇌]|\b\d+\s*/\s*\d+\b|\^|_\{|\\frac"
_SIGN = r"[=<>≤≥≠≈×÷±√∑∫→⇌^]"


def looks_like_math(c: Column) -> Column:
    """A hint of mathematics and at least one of its signs."""
    return (strip(c) != "") & c.rlike(_HINT) & c.rlike(_SIGN)


def escape_symbols(c: Column) -> Column:
    """Each symbol as its command, and a space after commands that need one."""
    return reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), F.lit(kv[1] + " " if kv[1].startswith("\\") else kv[1])), SYMBOLS.items(), c)


def script_text(runs: Column) -> Column:
    """Runs joined, raised and lowered ones as LaTeX scripts."""

    def one(r: Column) -> Column:
        t = escape_symbols(r["text"])
        return F.when(r["superscript"], F.concat(F.lit("^{"), strip(t), F.lit("}"))).when(r["subscript"], F.concat(F.lit("_{"), strip(t), F.lit("}"))).otherwise(t)

    return F.array_join(F.transform(runs, one), "")


def balanced(c: Column) -> Column:
    """As many opening as closing braces."""
    n = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    return n("{") == n("}")


def to_latex(runs: Column) -> Column:
    """struct(latex, confident) of runs that look like mathematics or have scripts; else null."""
    raw = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    scripts = F.exists(runs, lambda r: r["superscript"] | r["subscript"])
    latex = F.regexp_replace(script_text(runs), r"(?<![\d)])\b(\d+)\s*/\s*(\d+)\b", r"\\frac{$1}{$2}")
    latex = collapse_spaces(latex)
    sure = balanced(latex) & ~latex.rlike(r"[^\x00-\x7f]")
    return F.when(looks_like_math(raw) | scripts, F.struct(latex.alias("latex"), sure.alias("confident")))


#: Commands that plain text shows as characters.
_PLAIN = {r"\times": "×", r"\div": "÷", r"\pm": "±", r"\leq": "≤", r"\geq": "≥", r"\neq": "≠", r"\approx": "≈", r"\rightarrow": "→", r"\rightleftharpoons": "⇌", r"\cdot": "·", r"\Delta": "Δ", r"\alpha": "α", r"\beta": "β", r"\pi": "π"}


def plain_text(c: Column) -> Column:
    """LaTeX as readable text."""
    out = reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), _PLAIN.items(), c)
    out = F.regexp_replace(out, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    out = F.regexp_replace(out, r"\\[\[\]()]", "")
    out = F.regexp_replace(out, r"[_^]\{([^{}]*)\}", "$1")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[{}\\]", ""), r"\s{2,}", " "))


def needs_own_line(latex: Column) -> Column:
    """Long or stacked expressions."""
    fracs = (F.length(latex) - F.length(F.replace(latex, F.lit("\\frac"), F.lit("")))) / 5
    return (F.length(latex) > 70) | F.contains(latex, F.lit("\\begin{")) | (fracs >= 2)
