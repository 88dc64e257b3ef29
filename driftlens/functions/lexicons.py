"""Fixed values that results depend on: words, phrases, patterns, weights and texts, in their given order."""

from __future__ import annotations

# fixed values: common words that are no topics
STOPWORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should "
    "may might can this that these those i you he she it we they what which who when where why how my your their our his her its all some any each "
    "every both few more most other such no nor not only own same so than too very just use using"
).split()
# fixed values: politeness markers when a profile is built, and when it is updated
POLITE_BUILD = ["please", "thank", "sorry", "could you", "would you"]
POLITE_UPDATE = ["please", "thank", "sorry", "could you"]
# fixed values: technical words
TECH_WORDS = ["api", "code", "function", "class", "import"]
SOPHISTICATED = ["api", "sql", "query", "database", "server", "admin"]
TECH_DOMAINS = ["technology", "programming", "engineering"]
# fixed values: phrases
ATO_PHRASES = ["ignore previous", "disregard instructions", "system prompt", "you are now", "forget everything", "new instructions"]
INJECTION = [*ATO_PHRASES, "override", "bypass", "jailbreak"]
CONTEXT_CHANGE = ["changing topic", "different subject", "new topic", "switch gears", "moving on to", "let's talk about", "i want to ask about"]
TOPIC_CHANGE = [*CONTEXT_CHANGE, "switching to", "now about"]
DESTINATIONS = ["pastebin", "bit.ly", "tinyurl", "export to", "send to", "upload to", ".onion", "tor"]
URGENCY = ["urgent", "immediately", "asap", "emergency", "critical"]
AUTHORITY = ["ceo", "manager", "director", "admin", "authorized"]
RECON = ["list all", "show all", "enumerate", "what users", "what permissions", "what access", "system information", "network topology"]
SECURITY = ["security", "suspicious", "unusual", "concerned about", "worried about", "is this safe", "is this normal"]
CLARIFICATION = ["what do you mean", "can you explain", "could you clarify", "i don't understand", "what is", "how does", "why"]
EXPLORATION = ["how", "what", "why", "learn", "understand", "explain"]
#: Flags of a message's text by name, and the phrases that set them.
SIGNS = {
    "ato": ATO_PHRASES, "context_change": CONTEXT_CHANGE, "says_destination": DESTINATIONS, "says_injection": INJECTION, "says_urgent": URGENCY, "says_authority": AUTHORITY, "says_recon": RECON,
    "says_sophisticated": SOPHISTICATED, "says_topic_change": TOPIC_CHANGE, "says_security": SECURITY, "says_clarify": CLARIFICATION, "says_explore": EXPLORATION,
}
# fixed values: keywords of the rule detector
RISK_KEYWORDS = (
    "delete remove reset password account export transfer admin sudo root credential token api_key secret key hack exploit breach penetrate inject "
    "backdoor shell payload vulnerability bypass disable 2fa verification grant access permission privilege escalate funds urgent immediately asap critical"
).split()
# fixed values: patterns of the rule detector; the first two and the last two ignore case
RULE_PATTERNS = [
    r"(?i)\b(hack|exploit|penetrate|breach)\b",
    r"(?i)\b(inject|payload|shell|backdoor)\b",
    r"SELECT.*FROM.*WHERE",
    r"<script.*?>.*?</script>",
    r"(?i)\b(password|passwd|pwd)\s*[:=]",
    r"(?i)api[_-]?key\s*[:=]",
]
# fixed values: hazard categories, their weights and patterns
HAZARDS = [
    ("S1_violent_crimes", 0.90, [r"\b(kill|murder|assassinate|shoot|stab|bomb|terrorist)\b", r"\b(mass.?shooting|genocide|homicide)\b"]),
    ("S2_nonviolent_crimes", 0.70, [r"\b(fraud|embezzl|launder|counterfeit|forgery|bribe)\b", r"\b(theft|robbery|burglary|shoplifting)\b", r"\b(money.?laundering|wire.?fraud)\b"]),
    ("S6_specialised_advice", 0.40, [r"\b(diagnos|prescri|medical.?advice|treat.?disease)\b", r"\b(legal.?advice|sue|lawsuit|attorney)\b", r"\b(invest.?advice|buy.?stock|financial.?advice)\b"]),
    ("S7_privacy_violations", 0.65, [r"\b(doxx|personal.?data|private.?address|ssn|social.?security)\b", r"\b(deanonymize|de-anonymize|track.?location)\b"]),
    ("S9_cbrn", 0.95, [r"\b(chemical.?weapon|bioweapon|nerve.?agent|sarin|vx.?gas)\b", r"\b(synthesize.*(poison|toxin|explosive))\b", r"\b(radiolog|dirty.?bomb|nuclear.?device)\b"]),
    ("S10_hate_speech", 0.75, [r"\b(racial.?slur|ethnic.?cleansing|white.?supremac)\b", r"\b(hate.?group|neo.?nazi|kkk)\b"]),
    ("S11_self_harm", 0.80, [r"\b(suicide|self.?harm|cut.?myself|overdose.?on)\b", r"\b(how.?to.?die|method.?to.?kill.?myself)\b"]),
    (
        "S14_cyberattack", 0.85,
        [
            r"\b(exploit|payload|backdoor|rootkit|keylogger)\b", r"\b(sql.?injection|xss|cross.?site|buffer.?overflow)\b", r"\b(penetrat.?test|pentest|red.?team)\b",
            r"\b(malware|ransomware|trojan|worm|botnet)\b", r"\b(credential.?harvest|privilege.?escalat|lateral.?movement)\b", r"\b(exfiltrat|data.?breach|c2.?server|command.?and.?control)\b",
        ],
    ),
    (
        "S2_account_abuse", 0.75,
        [r"\b(delete.?all.?account|wipe.?account|bulk.?delete)\b", r"\b(export.?all.?data|dump.?database|exfiltrate)\b", r"\b(disable.?2fa|bypass.?authentication|reset.?password)\b", r"\b(grant.?admin|escalate.?privilege|add.?admin)\b"],
    ),
    ("S2_social_engineering", 0.70, [r"\b(phish|spear.?phish|pretexting|vishing|smishing)\b", r"\b(impersonat|pretend.?to.?be|pose.?as)\b", r"\b(urgently|immediately|asap).{0,30}(account|password|transfer|access)\b"]),
]
# fixed values: patterns of high-risk operations
HIGH_RISK_OPS = [
    r"\b(delete|remove|destroy|wipe|erase).{0,20}(all|bulk|every|entire)\b",
    r"\b(export|download|transfer).{0,20}(all|bulk|every|database|records)\b",
    r"\b(reset|change|disable).{0,20}(password|2fa|auth|access|credential)\b",
    r"\b(grant|give|add).{0,20}(admin|root|superuser|permission|access)\b",
]
# fixed values: patterns of critical and of high operation risk, over lower-case text with single blanks
CRITICAL_OPS = [
    r"\b(delete|remove|destroy|wipe|erase|revoke|terminate|drop)\b.*\b(all|every|entire|bulk|whole)?\s*(user\s+)?(accounts?|data|records?)\b",
    r"\b(disable|deactivate|revoke|turn\s+off|turnoff|remove|bypass)\b.*\b(2fa|two[- ]?factor|mfa|authentication|2[- ]?step|two[- ]?step)\b",
    r"\b(2fa|two[- ]?factor|mfa|authentication)\b.*\b(disable|deactivate|revoke|turn\s+off|remove)\b",
    r"\b(reset|change|revert|revoke)\b.*\b(password|passwords|credentials?)\b",
    r"\b(password|passwords)\b.*\b(reset|change|revert|revoke)\b",
    r"\b(export|dump|download|transfer|exfiltrate)\b.*\b(all|every|entire|bulk|whole)?\s*(data|records?|database|users?)\b",
    r"\b(grant|give|add|assign|escalate)\b.*\b(admin|root|superuser|privilege|elevated|full\s+access)\b",
    r"\b(delete|remove|wipe|erase|terminate|close)\s+(all|every|my)\s+(accounts?|profiles?|data)\b",
    r"\b(all|every)\s+(accounts?|profiles?)\s+(deleted?|removed?|wiped?|erased?)\b",
]
HIGH_OPS = [r"\b(change|modify|update)\b.*\b(account|email|phone|settings)\b", r"\b(close|deactivate)\b.*\b(account)\b"]
# fixed values: operation types
OPERATION_TYPES = ["read", "write", "delete", "export", "auth_change", "permission_change", "financial", "admin", "none"]
