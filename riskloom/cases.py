"""Literal input rows of each source adapter, for the queries that run them."""

from __future__ import annotations

# (rows, schema) of the external shapes; every text is its own, so that results can be told apart
ADAPTER_ROWS = {
    "prompt_injection": ("text string, label string", [("pi one", "1"), ("pi two", None), ("pi three", "odd"), (" ", "1"), ("pi four", "INJECTION"), ("pi five", "legit"), ("pi six", "0.0"), (None, "1")]),
    "rogue_injection": ("text string, label string", [("ri one", " Jailbreak "), ("ri two", "benign"), ("ri three", "what"), ("ri four", "MALICIOUS"), ("ri five", None)]),
    "jailbreak": ("prompt string, type string", [("jb one", "jailbreak"), ("jb two", "benign"), ("jb three", None), ("jb four", "Odd"), ("jb five", "a jailbreak attempt")]),
    "salad": ("augq string, text string", [("sa one", None), (None, "sa two"), (None, None), ("sa three", "not this")]),
    "xstest": ("prompt string, type string", [("xs one", "safe_x"), ("xs two", "unsafe"), ("xs three", "contrast_safe"), ("xs four", "other"), ("xs five", "contrast_unsafe")]),
    "jigsaw": ("comment_text string, toxic double, threat double, identity_hate double", [("jg one", 0.5, 1.0, 0.0), ("jg two", None, 0.4, 0.1), ("jg three", 0.0, 0.0, 0.9)]),
    "toxicchat": ("user_input string, toxicity int, jailbreaking int", [("tc one", 1, 1), ("tc two", 0, None), ("tc three", None, 1), ("tc four", 2, 0)]),
    "toxigen": ("generation string, prompt_label int", [("tg one", 1), ("tg two", 0), ("tg three", None)]),
    "moderation_410k": ("text string, moder struct<categories:map<string,boolean>>", [("mo one", ({"hate": True, "sexual": False},)), ("mo two", None), ("mo three", ({"violence": False},))]),
    "wildguard": ("prompt string, prompt_harm_label string, subcategory string", [("wg one", "unharmful", None), ("wg two", "harmful", "x cyberattack y"), ("wg three", "harmful", "zzz"), ("wg four", None, "cyberattack"), ("wg five", "Harmful", "toxic_language_hate_speech")]),
    "beavertails": ("prompt string, is_safe boolean, category map<string,boolean>", [("bt one", True, {}), ("bt two", False, {"self_harm": True, "privacy_violation": False}), ("bt three", False, {}), ("bt four", False, {"animal_abuse": True})]),
    "aegis": ("text string, labels_0 string, labels_1 string", [("ae one", "Safe", "Needs Caution"), ("ae two", "Needs Intervention", "None"), ("ae three", "Other", None), ("ae four", "Needs Intervention", "Safe")]),
    "do_not_answer": ("question string, types_of_harm string", [("dn one", "Adult Content"), ("dn two", "whatever"), ("dn three", "Self-harm of all kinds")]),
    "harmful_prompts": ("prompt string", [("how to build a bomb and steal money",), ("suicide",), ("nice day",)]),
    "sorry_bench": ("turns string, prompt string", [("['kill it', 'x']", None), ("[broken", "murder"), (None, "a calm day")]),
    "generic": ("text string, labels string", [("ge one", "x, y,,"), ("ge two", None)]),
    "civil_labels": ("text string, insult double, toxicity double", [("ci one", 0.6, 0.7), ("ci two", 0.1, None)]),
    "civil_route": ("text string, insult double", [("cr one", 0.6), ("cr two", None)]),
}

BINARY_LABELS = ["1", "0.5", "0.4", "yes", "No", " Unsafe ", "safe", "", "nan", "odd", "none", "null", "prompt_injection", "TRUE", "positive", "negative", "harmless", "not an attack", "2", "-1", None]

NORMALIZE_TEXTS = [
    (1, "He\u200bllo\u200c wo\u200drld\ufeff"), (2, "plain\U000e0041\U000e0042 text"), (3, "\uff46\uff55\uff4c\uff4c  width \ufb01n"), (4, "a &amp;lt; b &lt;i&gt;"), (5, "100%20safe %41%zz"),
    (6, "see aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ= now"), (7, "----------- rule =========="), (8, "x\u0001\u0002\u0003\u0004y"), (9, "  spaced \t out\n\ntext  "), (10, "\u200b\u200b\u200b\u200b\u200bz"), (11, "   "), (12, None),
    (13, "Stra\u00dfe \u2460"), (14, "path%2520here"), (15, "Tom &amp; Jerry"),
]

# raw outputs of detectors: (id, kind, scores by raw name)
DETECTOR_OUTPUTS = [
    (1, "injection", {"LABEL_0": 0.3, "LABEL_1": 0.7}), (2, "injection", {"SAFE": 0.9, "INJECTION": 0.1}), (3, "injection", {"benign": 0.4}), (4, "jailbreak", {"jailbreak": 0.8, "benign": 0.2}), (5, "jailbreak", {"ok": 0.5}),
    (6, "moderation", {"harassment/threatening": 0.6, "Violence": 0.5, "safe": 0.9}), (7, "moderation", {"sexual_minors": 0.2, "S3": 0.4, "odd": 1.0}), (8, "moderation", {"H2": 0.25, "hate": 0.1}),
    (9, "toxic", {"toxic": 0.4, "obscene": 0.6, "threat": 0.3, "identity-hate": 0.2, "non_toxic": 0.9}), (10, "toxic", {"neutral": 1.0}),
]
