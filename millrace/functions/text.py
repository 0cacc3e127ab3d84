"""Text expressions, JVM-side, and the few pure functions that the JVM lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.tokens import bound

#: White space and word characters as Python has them, over all of Unicode; ``\s`` and ``\b`` of the JVM differ.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"


def normalized_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and runs of white space."""
    plain = F.regexp_replace(F.lower(text), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"(?<!{WORD})(?:a|an|the)(?!{WORD})", " "), SPACE + "+", " "))


def token_f1(prediction: Column, truth: Column) -> Column:
    """Multiset token F1 of normalised texts; closed answers must agree as a whole; null scores 0."""
    both = F.struct(normalized_answer(prediction).alias("p"), normalized_answer(truth).alias("t"))
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    words = bound(both, lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t"), split(x["p"]).alias("a"), split(x["t"]).alias("b")))

    def score(x: Column) -> Column:
        count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
        shared = F.aggregate(F.array_intersect(x["a"], x["b"]), F.lit(0), lambda s, w: s + F.least(count(x["a"], w), count(x["b"], w)))
        closed = ("yes", "no", "noanswer")
        wrong = (x["p"] != x["t"]) & (x["p"].isin(*closed) | x["t"].isin(*closed))
        return F.when(wrong | (shared == 0) | x["p"].isNull() | x["t"].isNull(), 0.0).otherwise(2.0 * shared / (F.size(x["a"]) + F.size(x["b"])))

    return bound(words, score)


def split_answer(text: Column) -> tuple[Column, Column]:
    """Leading number and the unit behind it, which begins with a letter or any sign beyond ASCII; empty where there is none."""
    number = rf"(?s)^{SPACE}*([-+]?[0-9][0-9.,]*)"
    return F.regexp_extract(text, number, 1), F.regexp_extract(text, rf"{number}{SPACE}*+([A-Za-z[^\x00-\x7f]].*?){SPACE}*$", 2)


def sanitized_query(text: Column) -> Column:
    """Word characters of any script; everything else becomes one blank."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def normalize_question(text: str | None) -> str | None:
    """Compatibility form, case folded, white space collapsed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def collection(provenance: Column) -> Column:
    """One of the three collections by how the provenance begins; null for any other."""
    key = F.regexp_replace(F.lower(F.trim(provenance)), r"[\s_]+", "-")
    named = lambda n: (key == n) | key.startswith(n + "-") | key.startswith(n)
    return F.when(named("synthfp"), "SynthFP").when(named("realfp"), "RealFP").when(named("fermi-eval"), "Fermi-Eval")


def first_rule(text: Column, rules: Iterable[tuple[str, str]], other: str) -> Column:
    """Category of the first substring rule that holds, case disregarded."""
    out = None
    for part, name in rules:
        holds = F.contains(F.lower(text), F.lit(part))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(other)


# Kinds of kernels by what their names hold, in this order; a name must hold one of each group of parts.
KERNEL_RULES = (
    ((("nccl",),), "NCCL Communication"),
    ((("deep_ep",), ("dispatch",)), "DeepEP Dispatch (MoE)"),
    ((("deep_ep",), ("combine",)), "DeepEP Combine (MoE)"),
    ((("deep_ep",), ("clean",)), "DeepEP Buffer Clean"),
    ((("deep_ep",),), "DeepEP (other)"),
    ((("flash",), ("attn",)), "Flash Attention"),
    ((("sparse_attn",),), "Sparse Attention (MLA)"),
    ((("paged_mqa",),), "Paged MQA/MLA Logits"),
    ((("attention", "fmha"),), "Attention (other)"),
    ((("deep_gemm", "sm90_fp8_gemm"),), "DeepGEMM (FP8)"),
    ((("nvjet",),), "NvJet GEMM"),
    ((("gemm", "cutlass", "matmul", "cublas"),), "GEMM/MatMul (other)"),
    ((("topk",),), "TopK / MoE Routing"),
    ((("quant",),), "Quantization (FP8)"),
    ((("norm",),), "Normalization"),
    ((("triton", "fused"),), "Fused/Triton Kernels"),
    ((("elementwise",),), "Elementwise Ops"),
    ((("reduce", "softmax"),), "Reduce/Softmax"),
    ((("embedding",),), "Embedding"),
    ((("memcpy", "memset"),), "Memory Ops"),
    ((("index", "scatter", "gather"),), "Index/Gather/Scatter"),
    ((("cat",), ("batched",)), "Concat/Cat"),
)
OTHER_KERNEL = "Other Compute"


def kernel_kind(name: Column) -> Column:
    """Kind of a kernel by its name, case disregarded; null for null."""
    low, out = F.lower(name), None
    for groups, kind in KERNEL_RULES:
        holds = F.lit(True)
        for parts in groups:
            one = F.lit(False)
            for part in parts:
                one = one | F.contains(low, F.lit(part))
            holds = holds & one
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out.when(name.isNotNull(), OTHER_KERNEL)
