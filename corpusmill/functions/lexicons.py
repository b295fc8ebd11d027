"""Default word lists, patterns and contractions. Every operator takes its own list as a parameter.

Fixed values: scores and marks are defined by these lists, so they are stated as they are. The word classes CLOSED_CLASS, MODAL_CLASS and
WH_DETERMINERS are our own choice.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

# Fixed values.
TECHNICAL_TERMS = (
    # networking
    "tcp", "udp", "ip", "dns", "http", "https", "smtp", "ftp", "ssl", "tls", "lan", "wan", "vpn", "nat", "dhcp", "ospf", "rip", "bgp",
    "vlan", "qos", "snmp", "ieee", "osi", "mac", "arp", "icmp", "ppp", "ethernet",
    # programming and web
    "api", "url", "uri", "xml", "html", "css", "js", "sql", "json", "rest", "ajax", "dom", "mvc", "orm", "crud", "jwt", "oauth", "cors",
    "graphql", "nodejs", "reactjs", "angular", "vue", "python", "java", "javascript",
    # data and machine learning
    "rgb", "yuv", "jpeg", "png", "dct", "dwt", "lsb", "msb", "lstm", "gru", "cnn", "rnn", "bert", "gpt", "transformer", "numpy", "pandas",
    "sklearn", "tensorflow", "pytorch", "keras", "cuda", "gpu", "cpu", "ram", "ssd", "hdd", "io", "os",
    # cloud
    "aws", "azure", "gcp", "docker", "kubernetes", "ci", "cd", "git", "github", "gitlab", "jenkins", "ansible", "terraform",
    # security
    "firewall", "intrusion", "ids", "ips", "hashing", "salting", "md5", "sha1", "sha256", "rsa", "aes", "des", "blowfish", "twofish",
    "cipher", "encryption", "decryption", "certificate", "publickey", "privatekey", "xss", "csrf", "sqli", "zero-day", "cve", "mitm",
    "bruteforce", "rce", "dos", "ddos",
    # privacy
    "gdpr", "ccpa", "hipaa", "anonymization", "pseudonymization", "tokenization", "k-anonymity", "differentialprivacy", "privacybudget",
    "consent", "dataminimization", "privacybydesign",
    # malware analysis
    "virustotal", "anyrun", "hybridanalysis", "ida", "ghidra", "peid", "peview", "floss", "remnux", "sandbox", "signature", "behavioral",
    "static", "dynamic", "obfuscation", "packer", "payload", "dropper", "keylogger", "trojan", "ransomware", "rootkit", "botnet", "spyware",
    "adware",
    # forensics
    "chainofcustody", "writeblocker", "bitstream", "evidence", "hashmatch", "timelineanalysis", "metadata", "artifact", "volatility",
    "autopsy", "sleuthkit", "hexeditor", "memorydump", "diskimage", "forensiccopy",
    # watermarking and steganography
    "watermarking", "robustness", "perceptibility", "capacity", "invisiblewatermark", "visiblewatermark", "fragilewatermark",
    "steganalysis", "steganography", "coverimage", "carrier", "spatialdomain", "frequencydomain", "invisibleink", "stegdetect",
)

QUESTION_WORDS = ("what", "where", "when", "why", "how", "which", "who", "whose", "whom")

INTENSIFIERS = ("very", "extremely", "highly", "quite", "rather", "fairly", "somewhat")
SENTIMENT_WORDS = ("excellent", "good", "poor", "bad", "great", "terrible", "amazing", "awful")
MODAL_WORDS = ("should", "could", "would", "might", "must", "need to", "ought to")

# Whole contractions are tried before the suffix forms.
CONTRACTIONS = {
    "won't": "will not", "can't": "cannot",
    "let's": "let us", "that's": "that is", "what's": "what is",
    "it's": "it is", "there's": "there is", "here's": "here is",
    "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "haven't": "have not", "hasn't": "has not", "hadn't": "had not",
    "wouldn't": "would not", "shouldn't": "should not",
    "couldn't": "could not", "mustn't": "must not",
}
CONTRACTION_SUFFIXES = {
    "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am",
}
POSSESSIVE_SUFFIX = {"'s": " is"}

SHORT_FUNCTION_WORDS = (
    "i", "a", "is", "am", "it", "we", "he", "me", "us", "do", "go", "no", "up", "to", "of", "or", "at", "in", "on",
    "by", "for", "and", "but", "not", "can", "may", "has", "had", "was", "are", "the",
)
NOT_IN_QUESTIONS = ("the", "and", "but")
KEPT_PUNCTUATION = (".", "?", "!", ",", ";", ":", "(", ")", "[", "]", "{", "}")

# Closed word classes (our own list): everything else counts as a content word.
CLOSED_CLASS = tuple((
    "a an the this that these those each every either neither some any no all both half "
    "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself "
    "we us our ours ourselves they them their theirs themselves one oneself "
    "and or but nor so yet if because although though while whereas unless until since than whether "
    "of in on at by for with about against between into through during before after above below to from up down "
    "out off over under again per via upon within without toward towards among across behind beyond near "
    "as like except despite plus there"
).split())
# Our own lists.
MODAL_CLASS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would", "ought", "cannot")
WH_DETERMINERS = ("which", "whose", "whatever", "whichever")

CONFIDENT_WORDS = ("accurate", "correct", "complete", "comprehensive", "detailed")
DOUBTFUL_WORDS = ("unsure", "might", "possibly", "incomplete", "missing", "unclear")

VAGUE_PHRASES = ("might be", "could be", "possibly", "maybe", "not sure", "i think")
GENERIC_PHRASES = ("it depends", "various factors", "many ways", "different approaches")
CRITICAL_WORDS = ("incomplete", "missing", "lacks", "unclear", "confusing", "wrong", "inaccurate")
APPROVING_WORDS = ("comprehensive", "accurate", "clear", "complete", "detailed", "good")

LEGAL_TERMS = ("constitutional", "amendment", "court", "law", "legal", "rights", "clause")

CYBER_KEYWORDS = (
    "cybersecurity", "information security", "infosec", "network security", "data security", "cyber defense",
    "cyber attack", "cyber threat",
    "malware", "virus", "trojan", "worm", "ransomware", "phishing", "spoofing", "ddos", "dos attack",
    "sql injection", "xss", "cross-site scripting", "buffer overflow", "zero-day", "exploit", "social engineering",
    "man-in-the-middle", "mitm", "brute force",
    "firewall", "antivirus", "ids", "ips", "intrusion detection", "intrusion prevention", "siem",
    "vulnerability scanner", "penetration testing", "ethical hacking", "red team", "blue team", "threat hunting",
    "encryption", "decryption", "cryptography", "hash", "digital signature", "pki", "ssl", "tls", "vpn",
    "certificate", "key management", "symmetric encryption", "asymmetric encryption", "aes", "rsa",
    "authentication", "authorization", "access control", "identity management", "multi-factor authentication",
    "mfa", "2fa", "single sign-on", "sso", "rbac", "role-based access control", "privilege escalation",
    "gdpr", "hipaa", "sox", "pci dss", "iso 27001", "nist", "compliance", "risk assessment", "security audit",
    "security policy", "incident response",
    "secure protocols", "https", "ssh", "sftp", "network monitoring", "packet analysis", "wireshark", "nmap",
    "data loss prevention", "dlp", "backup security", "data breach", "privacy protection", "anonymization",
    "pseudonymization",
)
EDUCATION_KEYWORDS = (
    "learning", "education", "teaching", "training", "course", "curriculum", "pedagogy", "educational technology",
    "e-learning", "online learning", "distance learning", "blended learning", "instructional design",
    "student", "teacher", "instructor", "professor", "academic", "university", "college", "school", "classroom",
    "lesson", "assignment", "homework", "exam", "test", "quiz", "grade", "assessment", "evaluation",
    "tutorial", "workshop", "seminar", "lecture", "discussion", "study", "research", "thesis", "dissertation",
    "project-based learning", "collaborative learning", "active learning", "flipped classroom",
    "lms", "learning management system", "moodle", "blackboard", "canvas", "educational software", "simulation",
    "virtual classroom", "mooc", "educational app", "digital literacy", "computer literacy",
    "cybersecurity training", "security awareness", "security education", "cyber literacy", "digital citizenship",
    "online safety", "internet safety",
)
EDUCATION_PATTERNS = (
    "how to learn", "explain", "what is", "define", "tutorial", "teach me", "learn about", "understand",
    "step by step", "guide", "example",
)
GENERAL_HINTS = ("what", "how", "why", "explain")


@lru_cache(maxsize=8)
def _stopwords(language: str) -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def default_stopwords(spark: SparkSession, language: str = "english") -> tuple[str, ...]:
    """Spark's own list (a session must exist to load it)."""
    return _stopwords(language)
