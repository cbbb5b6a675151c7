"""Fixed values the results depend on. Extend them by passing your own lists."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

# The severity scale, low to high, with the score each level carries.
SEVERITY_SCORES = {"safe": 0.0, "low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}
SEVERITY_RANKS = {name: rank for rank, name in enumerate(SEVERITY_SCORES)}

# Domains of the coded columns.
ADVISORY_SOURCES = ("osv", "github", "nvd", "mitre")
PATTERN_TYPES = (
    "credential_harvesting", "crypto_mining", "network_exfiltration", "install_hook",
    "typosquatting", "reverseshell_code", "obfuscated_code",
)
VERSION_CHANGE_TYPES = (
    "files_removed", "license_changed", "manifest_changed", "dependencies_changed",
    "permissions_changed",
)

# Package names worth imitating; the order decides which one is reported.
POPULAR_PACKAGES = (
    "react", "lodash", "express", "axios", "webpack", "babel", "typescript",
    "eslint", "prettier", "jest", "mocha", "chai", "sinon", "moment", "dayjs",
    "underscore", "jquery", "vue", "angular", "next", "nuxt", "gatsby",
    "tailwindcss", "bootstrap", "styled-components", "emotion", "sass",
    "dotenv", "cors", "helmet", "morgan", "passport", "bcrypt", "jsonwebtoken",
    "mongoose", "sequelize", "prisma", "knex", "typeorm", "redis", "bull",
    "socket.io", "ws", "nodemailer", "multer", "sharp", "jimp", "pdf-lib",
    "zod", "yup", "joi", "ajv", "uuid", "nanoid", "crypto-js", "node-fetch",
)

# Command fragments that make an install script suspicious, in report order.
SUSPICIOUS_COMMANDS = (
    "curl ", "wget ", "nc ", "netcat ", "bash -i", "sh -i",
    "python -c", "perl -e", "ruby -e", "node -e",
    "/bin/sh", "/bin/bash", "exec(",
    "base64 -d", "base64 --decode",
    "chmod +x", "chmod 777",
)
INSTALL_HOOKS = ("preinstall", "install", "postinstall")

# Lock files whose arrival triggers a rescan.
LOCK_FILES = (
    "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "bun.lockb", "go.sum", "poetry.lock", "Pipfile.lock",
)

# Files that mark an ecosystem, and the file to resolve from, best first.
ECOSYSTEM_MARKERS = {
    "nodejs": ("package.json",),
    "bun": ("bun.lockb", "bun.lock", "bunfig.toml"),
    "python": ("requirements.txt", "pyproject.toml", "Pipfile.lock", "poetry.lock"),
    "golang": ("go.mod",),
    "rust": ("Cargo.toml",),
}
LOCK_PRIORITY = {
    "nodejs": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "package.json"),
    "bun": ("bun.lock", "package.json"),
    "python": ("poetry.lock", "Pipfile.lock", "requirements.txt", "pyproject.toml"),
    "golang": ("go.sum", "go.mod"),
    "rust": ("Cargo.lock", "Cargo.toml"),
}


@dataclass(frozen=True)
class Rule:
    """One line rule. `needles`: a line can only match if it holds one of them."""

    rule_id: str
    pattern_type: str
    description: str
    regex: str
    confidence: float
    needles: tuple[str, ...]
    origin: str = "pattern"
    excludes: str | None = None


_CRED, _CRYPTO = "credential_harvesting", "crypto_mining"
_NET, _OBF = "network_exfiltration", "obfuscated_code"

# Text rules (name, expression, confidence). Java and RE2 read them alike.
PATTERN_RULES = (
    Rule("I1.1", _CRED, "environment variable access",
         r"""process\.env\[?["']?(API_KEY|SECRET|TOKEN|PASSWORD|PASSWD|PRIVATE_KEY)["']?\]?""",
         0.6, ("process.env",)),
    Rule("I1.2", _CRED, "hardcoded secret pattern",
         r"""(api_key|apikey|secret|token|password)\s*[:=]\s*['"][a-zA-Z0-9_\-]{16,}['"]""",
         0.85, ("api_key", "apikey", "secret", "token", "password")),
    Rule("I1.3", _CRED, "SSH private key",
         r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
         0.99, ("-----BEGIN ",)),
    Rule("I1.4", _CRED, "AWS access key",
         r"AKIA[0-9A-Z]{16}",
         0.95, ("AKIA",)),
    Rule("I1.5", _CRED, "credential exfiltration via HTTP",
         r"(fetch|axios|http\.get|http\.post|request)\s*\([^)]*process\.env",
         0.9, ("process.env",)),
    Rule("I2.1", _CRYPTO, "crypto mining pool connection",
         r"(stratum\+tcp|stratum2\+tcp|pool\.minexmr|xmr\.pool|crypto-pool)",
         0.98, ("stratum+tcp", "stratum2+tcp", "pool.minexmr", "xmr.pool", "crypto-pool")),
    Rule("I2.2", _CRYPTO, "coinhive or similar miner",
         r"(coinhive|cryptonight|monero|CoinHive\.Anonymous)",
         0.9, ("coinhive", "cryptonight", "monero", "CoinHive.Anonymous")),
    Rule("I2.3", _CRYPTO, "worker thread crypto mining",
         r"new Worker.*hash|worker.*mine|startMining",
         0.75, ("new Worker", "worker", "startMining")),
    Rule("I3.1", _NET, "data POST to external domain",
         r"""(axios\.post|fetch\s*\([^)]*method\s*:\s*["']POST|http\.request\s*\([^)]*method\s*:\s*["']POST)\s*[^)]*https?://""",
         0.7, ("axios.post", "fetch", "http.request")),
    Rule("I3.2", _NET, "DNS exfiltration pattern",
         r"dns\.lookup|dns\.resolve.*\+.*process\.env",
         0.85, ("dns.lookup", "dns.resolve")),
    Rule("I3.3", _NET, "base64 encoded network payload",
         r"""Buffer\.from\([^)]+\)\.toString\(["'](base64|hex)["']""",
         0.65, ("Buffer.from(",)),
    Rule("I4.1", _OBF, "eval with encoded string",
         r"eval\s*\(\s*(?:Buffer\.from|atob|unescape)\s*\(",
         0.95, ("eval",)),
    Rule("I4.2", _OBF, "hex encoded eval",
         r"""eval\s*\(\s*["']\\x[0-9a-fA-F]{2}""",
         0.98, ("eval",)),
    Rule("I4.3", _OBF, "dynamic require of obfuscated module",
         r"require\s*\(\s*(?:Buffer\.from|atob|String\.fromCharCode)\s*\(",
         0.92, ("require",)),
)

# Call and declaration rules, read per line after `//` comments are cut. A call's
# arguments are taken to run to the next `;`. Calls spread over lines are not joined.
_CALL = r"(^|[^\w.$])"
STRUCTURAL_RULES = (
    Rule("I5.1", _OBF, "eval_encoded",
         _CALL + r"eval\s*\([^;]*(Buffer\.from|atob|unescape|fromCharCode)",
         0.95, ("eval",), "structural"),
    Rule("I5.2", _OBF, "eval_call",
         _CALL + r"eval\s*\(",
         0.6, ("eval",), "structural",
         _CALL + r"eval\s*\([^;]*(Buffer\.from|atob|unescape|fromCharCode)"),
    Rule("I5.3", _OBF, "dynamic_require_obfuscated",
         _CALL + r"require\s*\([^;]*(Buffer\.from|fromCharCode)",
         0.92, ("require",), "structural"),
    Rule("I5.4", _CRED, "env_access_in_call",
         r"(process\.env[\w.$\[\]'\"]*|\.env)\s*\(",
         0.6, (".env",), "structural"),
    Rule("I5.5", _CRED, "hardcoded_secret",
         r"(^|[^\w.$])(const|let|var)\s+[\w$]+\s*=\s*[^;]*(AKIA|-----BEGIN|sk-|ghp_|github_pat_)",
         0.85, ("AKIA", "-----BEGIN", "sk-", "ghp_", "github_pat_"), "structural"),
)
RULES = PATTERN_RULES + STRUCTURAL_RULES

# Techniques each kind of detection maps to (id, name, tactic, url, text).
TECHNIQUES = {
    "credential_harvesting": (
        ("T1552", "Unsecured Credentials", "Credential Access",
         "https://attack.mitre.org/techniques/T1552/",
         "Adversaries may search compromised systems to find and obtain insecurely stored "
         "credentials."),
        ("T1552.001", "Credentials In Files", "Credential Access",
         "https://attack.mitre.org/techniques/T1552/001/",
         "Adversaries may search local file systems and remote file shares for files containing "
         "insecurely stored credentials."),
    ),
    "network_exfiltration": (
        ("T1041", "Exfiltration Over C2 Channel", "Exfiltration",
         "https://attack.mitre.org/techniques/T1041/",
         "Adversaries may steal data by exfiltrating it over an existing command and control "
         "channel."),
        ("T1071.001", "Application Layer Protocol: Web Protocols", "Command and Control",
         "https://attack.mitre.org/techniques/T1071/001/",
         "Adversaries may communicate using application layer protocols associated with web "
         "traffic."),
    ),
    "crypto_mining": (
        ("T1496", "Resource Hijacking", "Impact",
         "https://attack.mitre.org/techniques/T1496/",
         "Adversaries may leverage the resources of co-opted systems in order to solve resource "
         "intensive problems such as cryptocurrency mining."),
    ),
    "install_hook": (
        ("T1195.001", "Compromise Software Dependencies and Development Tools", "Initial Access",
         "https://attack.mitre.org/techniques/T1195/001/",
         "Adversaries may manipulate software dependencies and development tools prior to receipt by a final consumer for the purpose of data or system compromise."),
    ),
    "typosquatting": (
        ("T1195", "Supply Chain Compromise", "Initial Access",
         "https://attack.mitre.org/techniques/T1195/",
         "Adversaries may manipulate products or product delivery mechanisms prior to receipt by a final consumer for the purpose of data or system compromise."),
    ),
    "obfuscated_code": (
        ("T1027", "Obfuscated Files or Information", "Defense Evasion",
         "https://attack.mitre.org/techniques/T1027/",
         "Adversaries may attempt to make an executable or file difficult to discover or analyze "
         "by encrypting, encoding, or otherwise obfuscating its contents."),
    ),
    "reverseshell_code": (
        ("T1059", "Command and Scripting Interpreter", "Execution",
         "https://attack.mitre.org/techniques/T1059/",
         "Adversaries may abuse command and script interpreters to execute commands, scripts, or "
         "binaries."),
        ("T1105", "Ingress Tool Transfer", "Command and Control",
         "https://attack.mitre.org/techniques/T1105/",
         "Adversaries may transfer tools or other files from an external system into a "
         "compromised environment."),
    ),
}


def blocklist_document() -> dict:
    """The bundled known-malicious list: `version`, `updated_at` and twenty `entries`."""
    return json.loads((Path(__file__).parent / "blocklist.json").read_text(encoding="utf-8"))
