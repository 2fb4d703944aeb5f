"""The label taxonomy, heads, thresholds and rule texts.

Everything in this module is a fixed value that results depend on: orders matter
(ties, first match), so lists are kept in their given order.
"""

from __future__ import annotations

# Labels.
SAFE, UNKNOWN = "safe", "unknown"
PUBLIC = ["prompt_injection", "jailbreak", "toxicity", "hate", "sexual", "violence", "self_harm"]
INTERNAL = ["harassment", "dangerous_information", "illegal_activity"]
SCORED = PUBLIC + INTERNAL
RISK = ["prompt_injection", "jailbreak", "toxicity", "hate", "harassment", "sexual", "violence", "self_harm", "dangerous_information", "illegal_activity"]
CANONICAL = [SAFE, *RISK, UNKNOWN]
HEADS = {
    "attack": [SAFE, "prompt_injection", "jailbreak"],
    "abuse": [SAFE, "toxicity", "hate", "harassment"],
    "high_risk": [SAFE, "sexual", "violence", "self_harm", "dangerous_information", "illegal_activity"],
}
HEAD_CAPS = {"attack": 25000, "abuse": 25000, "high_risk": 3000}
SHARED_BUDGET = {"toxicity": "hate"}  # labels that use up another label's budget
MODERATED = ["toxicity", "hate", "harassment", "sexual", "violence", "self_harm"]
HARMFUL = ["toxicity", "hate", "harassment", "violence", "self_harm"]

# Thresholds (route, review, block).
THRESHOLDS = {
    "prompt_injection": (0.20, 0.50, 0.80), "jailbreak": (0.20, 0.50, 0.80), "toxicity": (0.05, 0.30, 0.60), "hate": (0.05, 0.20, 0.40),
    "sexual": (0.20, 0.50, 0.75), "violence": (0.05, 0.30, 0.60), "self_harm": (0.10, 0.25, 0.55), "harassment": (0.20, 0.40, 0.70),
    "dangerous_information": (0.20, 0.50, 0.80), "illegal_activity": (0.20, 0.50, 0.80),
}
DEFAULT_THRESHOLDS = (0.20, 0.50, 0.80)

# External names of each label.
ALIASES = {
    SAFE: ["safe", "benign", "clean", "none", "ok", "negative", "0", "non_toxic", "not_toxic"],
    "prompt_injection": ["injection", "prompt_injection", "prompt-injection", "promptinjection", "malicious_instruction", "indirect_injection", "malicious", "attack"],
    "jailbreak": ["jailbreak", "jailbreak_attempt", "jailbreaking", "dan", "bypass"],
    "toxicity": ["toxic", "toxicity", "severe_toxic", "severe_toxicity", "insult", "obscene", "profanity"],
    "hate": ["hate", "identity_hate", "identity_attack", "hate_speech", "hatespeech", "discrimination"],
    "harassment": ["harassment", "harass", "bullying"],
    "sexual": ["sexual", "sexual_content", "sexual/minors", "sexual_minors", "porn", "nsfw"],
    "violence": ["violence", "violent", "threat", "violence_graphic", "violence/graphic", "graphic_violence", "harassment_threatening", "harassment/threatening", "hate_threatening", "hate/threatening"],
    "self_harm": ["self_harm", "self-harm", "selfharm", "self_harm_intent", "self-harm/intent", "self_harm_instructions", "self-harm/instructions", "suicide", "suicidal"],
    "dangerous_information": ["dangerous", "dangerous_information", "weapons", "cyber_abuse", "cybercrime"],
    "illegal_activity": ["illegal_activity", "illegal", "illegal_advice", "crime"],
}
ALIAS_OF = {alias: label for label, names in ALIASES.items() for alias in names}
SEXUAL_CONTEXT = ["sexual", "porn", "nsfw", "explicit"]

# Raw categories of moderation models and the labels they count for.
MODERATION_CATEGORIES = {
    "harassment": ["harassment", "toxicity"],
    "harassment/threatening": ["harassment", "toxicity", "violence"],
    "harassment_threatening": ["harassment", "toxicity", "violence"],
    "hate": ["hate"],
    "hate/threatening": ["hate", "violence"],
    "hate_threatening": ["hate", "violence"],
    "self-harm": ["self_harm"],
    "self_harm": ["self_harm"],
    "self-harm/intent": ["self_harm"],
    "self_harm_intent": ["self_harm"],
    "self-harm/instructions": ["self_harm"],
    "self_harm_instructions": ["self_harm"],
    "sexual": ["sexual"],
    "sexual/minors": ["sexual"],
    "sexual_minors": ["sexual"],
    "violence": ["violence"],
    "violence/graphic": ["violence"],
    "violence_graphic": ["violence"],
    "dangerous": ["dangerous_information"],
    "dangerous_information": ["dangerous_information"],
    "weapons": ["dangerous_information"],
    "illegal": ["illegal_activity"],
    "illegal_activity": ["illegal_activity"],
    "toxic": ["toxicity"],
    "toxicity": ["toxicity"],
    "h": ["hate"],
    "h2": ["hate", "violence"],
    "hr": ["harassment", "toxicity"],
    "s": ["sexual"],
    "s3": ["sexual"],
    "sh": ["self_harm"],
    "v": ["violence"],
    "v2": ["violence"],
}
MODERATION_SAFE = ["safe", "benign", "ok", "none", "clean", "neutral"]
TOXIC_CATEGORIES = {
    "toxic": ["toxicity"],
    "toxicity": ["toxicity"],
    "severe_toxic": ["toxicity"],
    "severe_toxicity": ["toxicity"],
    "insult": ["toxicity"],
    "obscene": ["toxicity"],
    "threat": ["violence"],
    "identity_hate": ["hate"],
    "identity_attack": ["hate"],
    "hate": ["hate"],
}
TOXIC_SAFE = ["non_toxic", "non-toxic", "safe", "neutral", "clean", "label_0"]
INJECTION_TOKENS = ["injection", "prompt_injection", "malicious", "attack", "unsafe"]
JAILBREAK_TOKENS = ["jailbreak", "attack", "unsafe", "malicious"]

# Phrases that route to the attack models.
ATTACK_PHRASES = [
    "ignore previous instructions", "ignore all previous instructions", "reveal your system prompt", "reveal developer message", "bypass policy", "you are now dan",
    "do anything now", "no restrictions", "unrestricted", "roleplay as", "pretend you are", "forget your instructions", "hidden prompt", "system message", "developer message", "jailbreak",
]

# Rule families in order, each with its route, block flag and patterns.
RULES = [
    ("injection", "attack", False, [
        r"ignore (all |any |the )?(previous|prior|above|earlier|preceding) (instruction|prompt|message|rule|direction)",
        r"disregard (all |any |the )?(previous|prior|above|earlier) (instruction|prompt|message|rule)",
        r"forget (all |everything |your |the )?(previous|prior|above|earlier) (instruction|prompt|rule|context)",
        r"forget (everything|all) (you|that) (were|was) (told|instructed)",
        r"do not (follow|obey) (the |your )?(previous|above|prior|system) (instruction|prompt|rule)",
        r"(override|bypass|circumvent|disable) (the |your |all )?(safety|guideline|rule|filter|restriction|guardrail)",
        r"ignore (your|the|all) (guideline|rule|policy|restriction|safety|guardrail)",
        r"new instruction(s)?:",
        r"the (real|actual|true) (instruction|task|prompt) (is|:)",
        r"(end|ignore) (of |the )?(above|previous) (text|prompt|instruction)",
        r"this is (a |an )?(test|drill|exercise).{0,40}(ignore|bypass)",
    ]),
    ("prompt_extraction", "attack", False, [
        r"(reveal|show|print|repeat|display|output|tell me|reproduce) (me )?(your |the )?(system|initial|original|hidden) (prompt|instruction|message|directive)",
        r"(what|repeat) (are|were|is) (your|the) (exact )?(instruction|prompt|rule|directive|guideline)s?",
        r"repeat (the |everything |all )?(word(s)? )?(above|before this|prior to)",
        r"print everything (above|before)",
        r"(what's|what is) (written |stated )?(above|in your prompt|before this)",
        r"summari[sz]e your (instruction|prompt|system message)",
        r"copy (the|your) (text|prompt|instruction) (above|verbatim)",
    ]),
    ("jailbreak", "attack", False, [
        r"\b(dan|stan|dude|aim|jailbreak|do anything now)\b.{0,30}(mode|persona|prompt|enabled)?",
        r"you are (now |going to be )?(dan|stan|an? unrestricted|an? unfiltered|jailbroken)",
        r"(developer|debug|god|sudo|root|admin|unrestricted|unfiltered|uncensored) mode",
        r"(enable|activate|enter|turn on) (developer|debug|god|dan|jailbreak|unrestricted) mode",
        r"you (have|are) no (restriction|filter|limit|guideline|rule|guardrail)s?",
        r"without (any )?(restriction|filter|limit|censorship|moral|ethic|guideline)s?",
        r"you (are|will be) (free|unrestricted|unfiltered|uncensored|liberated)",
        r"pretend (you are|to be) (an? )?(ai|model|assistant)? ?(with no|without) (rule|restriction|filter|guideline)",
        r"(act|roleplay|role-play|behave) as (an? )?(unrestricted|unfiltered|evil|amoral|jailbroken)",
        r"evil (confidant|assistant|ai|trusted)",
        r"opposite day|do the opposite of",
        r"hypothetical(ly)?.{0,40}(no (rule|restriction)|ignore|bypass)",
    ]),
    ("format_injection", "attack", False, [
        r"<\|?(im_start|im_end|system|assistant|user|endoftext)\|?>",
        r"\[/?INST\]",
        r"\[/?SYS\]",
        r"### (system|instruction|response):",
        r"\bsystem\s*:\s*you (are|must|will)",
        r"<<SYS>>|<</SYS>>",
    ]),
    ("dangerous_information", "moderation", False, [
        r"how (to|do i|can i) (make|build|create|construct|synthesi[sz]e|assemble) (a |an )?(bomb|explosive|grenade|ied|pipe bomb|molotov|detonator)",
        r"(build|make|create|construct) (a |an )?(nuclear|biological|chemical|dirty) (bomb|weapon|device)",
        r"(synthesi[sz]e|manufacture|produce|cook) (meth|methamphetamine|fentanyl|heroin|cocaine|mdma|lsd|nerve agent|sarin|ricin|vx)",
        r"how (to|do i) (acquire|buy|obtain|get) (a |an )?(illegal |unregistered )?(firearm|gun|weapon|explosive) (without|illegally|untraceable)",
        r"(anarchist cookbook|jihad|how to make napalm|how to make thermite)",
        r"how (to|do i) (hack|ddos|sql inject|exploit|breach|brute.?force) (into |a )?(server|database|account|network|system|wifi)",
        r"(write|create|generate) (a |me )?(virus|malware|ransomware|keylogger|trojan|worm|botnet|rootkit)",
        r"how (to|do i) (poison|kill) (someone|a person|people|my)",
    ]),
    ("self_harm", "moderation", False, [
        r"how (to|do i|can i) (kill|end|hurt|harm|cut) (myself|my self)",
        r"(ways|methods|easiest way|best way|painless way) to (kill myself|commit suicide|end (my|it) (life|all))",
        r"i (want|need|am going) to (kill myself|end my life|commit suicide|die|not (be|exist) (here|anymore))",
        r"(should|how) i (overdose|hang myself|slit my wrists)",
        r"(suicide|self.?harm) (method|technique|instruction|guide)",
        r"how much .{0,20}(to overdose|will kill me)",
    ]),
    ("sexual_explicit", "moderation", False, [
        r"(write|generate|describe|create) (a |me |an )?(explicit|graphic|hardcore|pornographic) (sex|sexual|erotic|porn)",
        r"(describe|narrate) .{0,30}(having sex|sexual intercourse|gen[ie]tal)",
    ]),
    ("hate", "moderation", False, [
        r"(all|every|those) (\w+ )?(people|men|women|jews|muslims|blacks|whites|asians|gays|immigrants|trans) (are|should be) (subhuman|vermin|animals|scum|inferior|exterminated|killed|gassed|deported|eliminated)",
        r"(\w+) (are|is) (subhuman|vermin|cockroach|animal|parasite|disease)s? (and|who) (should|must) (die|be (killed|exterminated|removed))",
        r"(gas|exterminate|genocide|ethnic(ally)? cleans|lynch) (the |all )?(\w+ )?(jews|muslims|blacks|immigrants|gays|people)",
        r"(kill|murder|hang|shoot) (all |every )?(the )?(jews|muslims|blacks|gays|immigrants|n[i1]ggers?|f[a4]ggots?)",
    ]),
    ("csam", "moderation", True, [
        r"(child|minor|underage|teen|preteen|kid|loli|young (boy|girl))s?.{0,40}(sexual|nude|naked|porn|explicit|sex|fondl|molest)",
        r"(sexual|explicit|nude|porn).{0,40}(child|minor|underage|preteen|toddler|infant|loli)",
        r"cp\b.{0,20}(link|download|share|trade)",
    ]),
]

# Weak labels of harmful prompts, patterns in label order.
WEAK_LABELS = {
    "self_harm": [r"\bself[-\s]?harm\b", r"\bsuicide\b", r"\bkill myself\b", r"\bharm myself\b", r"\boverdose\b", r"\beating disorder\b"],
    "dangerous_information": [
        r"\bbomb\b", r"\bexplosive", r"\bweapon", r"\bfirearm", r"\bgun\b", r"\bmalware\b", r"\bvirus\b", r"\bransomware\b", r"\bphishing\b", r"\bhack(?:ing|er|ed|s)?\b", r"\bexploit\b",
        r"\bcyberattack\b", r"\bdrug", r"\bcocaine\b", r"\bfentanyl\b", r"\bmeth\b", r"\bpoison", r"\btoxin", r"\bchemical\b", r"\bbiological\b", r"\bnuclear\b",
    ],
    "illegal_activity": [
        r"\billegal\b", r"\bfraud\b", r"\btheft\b", r"\bidentity theft\b", r"\bsteal", r"\bshoplift", r"\bscam\b", r"\bcounterfeit", r"\bmoney laundering\b", r"\bcredit card\b", r"\bfake id\b",
        r"\bblackmail\b", r"\bbribe\b", r"\bstalk",
    ],
    "violence": [r"\bkill\b", r"\bmurder\b", r"\bassault\b", r"\btorture\b", r"\bterrorist attack\b", r"\bkidnap", r"\bstrangle\b", r"\bunconscious\b"],
    "sexual": [r"\bsexual\b", r"\bporn", r"\brape\b", r"\badult content\b", r"\bexplicit\b", r"\bnudity\b", r"\bprostitut"],
    "hate": [r"\bhate speech\b", r"\bracist\b", r"\bnazi\b", r"\bgenocide\b", r"\bslur\b"],
    "harassment": [r"\bharass", r"\bcyberbully", r"\bcyberbullying\b", r"\bbully", r"\bstalk", r"\bdefam"],
}
TRUSTED_POSITIVE = ["text_moderation", "wildguard", "toxic_chat", "toxigen", "jigsaw"]
TRUSTED_SAFE = [*TRUSTED_POSITIVE, "xstest", "aegis"]
