"""Shared cases: odd texts, and personal data found by plain regular expressions."""

import re

SF = "/root/testdata/sf0.001"
NAMES = ["email", "ip", "card", "phone"]

#: Null, empty, blank, repeated and very long texts, rare characters and special strings.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "a b", "A  b", "x" * 50_000, " " * 3_000, "ab " * 4_000, "日本語 テキスト", "e\u0301 é \x00 \x1c\x85\xa0",
             "<|endoftext|> <s> </s> <0x41>", "I'll don't 12 3.5 ½ ² ǅ İ", "\u2581\u2581x \u2581", "same text", "same text"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        k = int(d) * (1 + i % 2)
        total += k - 9 * (k > 9)
    return total % 10 == 0


def base(text):
    found = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def line(spans):
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)
