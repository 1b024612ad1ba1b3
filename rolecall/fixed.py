"""Vocabulary, weights, paths and patterns the results depend on.

Everything here is data, not logic.  Changing a value changes results.
"""

# --- roles -----------------------------------------------------------------
# Weight of each role in the ranking score.
ROLE_WEIGHT = {
    "steering_council": 1.00,
    "author": 0.86,
    "maintainer": 0.85,
    "standards_author": 0.82,
    "code_owner": 0.80,
    "release_manager": 0.78,
    "core_contributor": 0.70,
    "org_member": 0.40,
    "contributor": 0.10,
}
# Weight of a role not listed.
UNKNOWN_ROLE_WEIGHT = 0.1

# Order in which several roles of one project are listed.
ROLE_DISPLAY_ORDER = [
    "author",
    "standards_author",
    "steering_council",
    "core_contributor",
    "code_owner",
    "release_manager",
    "maintainer",
    "org_member",
    "contributor",
]

# Roles too weak to keep a project on their own.
WEAK_ROLES = ["contributor", "org_member"]

# Human labels.
ROLE_LABEL = {
    "maintainer": "Maintainer",
    "code_owner": "Code owner",
    "steering_council": "Steering council",
    "standards_author": "Standards author",
    "author": "Author",
    "release_manager": "Release manager",
    "core_contributor": "Core contributor",
    "org_member": "Org member",
    "contributor": "Contributor",
}

# Report line of a person without a shown project, after the login.
NO_ROLES = ": no elevated roles found."

# --- hosts -----------------------------------------------------------------
# Web host of each known code host.
DEFAULT_FORGE = "github"
WEB_HOST = {
    "github": "https://github.com",
    "gitlab": "https://gitlab.com",
    "codeberg": "https://codeberg.org",
    "gitee": "https://gitee.com",
    "bitbucket": "https://bitbucket.org",
}

# First path segments that are never a repository owner.
NON_REPO_OWNERS = [
    "sponsors", "orgs", "users", "topics", "features", "about",
    "settings", "marketplace", "apps",
]
# First path segments that are never a user profile.
NON_PROFILE = [
    "sponsors", "orgs", "users", "topics", "features", "about", "settings",
    "marketplace", "apps", "explore", "help", "pricing", "-", "dashboard",
]

# --- discovery -------------------------------------------------------------
# Discovery sources.  The position is the bit used to fold a set
# of sources into one BIGINT, so that merging is a plain hash aggregate.
SOURCES = [
    "owned", "fork-parent", "contributed", "org-repo", "history", "profile",
    "search:CODEOWNERS", "search:MAINTAINERS", "search:OWNERS", "search:GOVERNANCE",
    "namesearch:AUTHORS", "namesearch:THANKS", "namesearch:CONTRIBUTORS",
    "commit-search", "registry", "pkg:npm", "pkg:crates", "pkg:pypi",
    "reverse-index", "manual",
]
# Sources that alone prove little, and sources that prove a contribution.
SPECULATIVE_SOURCES = ["org-repo", "registry"]
GENUINE_SOURCES = ["contributed", "history"]

# Role files searched for a handle, credit files for a name.
HANDLE_SEARCH_FILES = ["CODEOWNERS", "MAINTAINERS", "OWNERS", "GOVERNANCE"]
NAME_SEARCH_FILES = ["AUTHORS", "THANKS", "CONTRIBUTORS"]

# --- role documents --------------------------------------------------------
# File locations in priority order.
CODEOWNERS_PATHS = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"]
MAINTAINERS_PATHS = [
    "MAINTAINERS", "MAINTAINERS.md", "MAINTAINERS.txt", "MAINTAINERS.rst",
    "docs/MAINTAINERS.md", ".github/MAINTAINERS.md",
]
OWNERS_PATHS = ["OWNERS"]
GOVERNANCE_PATHS = [
    "GOVERNANCE.md", "GOVERNANCE.rst", "docs/GOVERNANCE.md",
    "STEERING.md", "docs/source/governance.rst", ".github/GOVERNANCE.md",
    "governance.md",
]
CREDIT_PATHS = [
    "AUTHORS", "AUTHORS.txt", "AUTHORS.rst", "AUTHORS.md",
    "THANKS", "THANKS.txt", "THANKS.rst", "THANKS.md",
    "CONTRIBUTORS", "CONTRIBUTORS.txt", "CONTRIBUTORS.md",
    "doc/source/dev/THANKS.txt",
]
MANIFEST_PATHS = [
    "pyproject.toml", "setup.cfg", "setup.py", "package.json", "Cargo.toml",
    "composer.json",
]
PROPOSAL_DIRS = ["peps", "doc/neps", "neps", "proposals", "."]
PROPOSAL_INDEX_FILES = ["index.md", "README.md", "index.rst", "readme.md"]

# Patterns.
TEAM_OWNER = r"^@([A-Za-z0-9-]+)/([A-Za-z0-9._-]+)$"
USER_OWNER = r"^@([A-Za-z0-9-]+)$"
EMAIL_OWNER = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MENTION = r"@([A-Za-z0-9-]+)"
WRAPPED_MENTION = r"\(?@([A-Za-z0-9-]+)\)?"
# (An address can only start where its run of letters starts; saying so keeps the
# search linear on long runs without an @.)
ANY_EMAIL = r"<([^>]+)>|(?<![^\s<>()])([^\s<>()]+@[^\s<>()]+\.[^\s<>()]+)"
ANGLE_EMAIL = r"<([^>]+)>"
HEADER_FIELD = r"^:?([A-Za-z][\w\- ]*?):\s*(.*)$"
PERSON_STRING = r"^([^<(]*?)\s*(?:<([^>]+)>)?\s*(?:\(([^)]*)\))?\s*$"
COUNCIL_WORDS = (
    r"(?i)steering council|steering committee|technical (?:steering )?committee|"
    r"\btsc\b|core team|council member|governing board|bdfl|project lead"
)
MAINTAINER_WORDS = r"(?i)maintainer|core developer|core contributor|lead"
BOT_LOGIN = r"(?i)\[bot\]$"
README_REPO_LINK = r"github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
GITHUB_REPO = r"(?i)github\.com[:/]+([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
PAGE_HANDLE = r"(?i)github\.com/([A-Za-z0-9-]+)"
ANY_URL = r"""https?://[^\s)"'<>\]]+"""
PROFILE_URL = r"https?://([^/\s]+)/([^/?#\s]+)/?(?:[?#].*)?$"
INFOBOX_AUTHOR = r"(?im)^\s*\|\s*author\s*=\s*(.+)$"
NOT_A_PERSON = (
    r"(?i)\b(team|project|community|contributors?|developers?|foundation|inc\.?|"
    r"llc|group|labs?)\b"
)
CREATE_VERB = (
    r"(?:(?:originally|initially|first|co)[ -]?)*"
    r"(?:started|created|founded|written|authored|developed|"
    r"designed|invented|built|launched)"
)
CAPITALISED_NAME = r"[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){1,3}"

# --- confidences and thresholds -------------------------------------------
# Base confidence of package evidence, by registry.
PACKAGE_CONFIDENCE = {"crates": 0.85, "pypi": 0.8, "npm": 0.78}
PACKAGE_CONFIDENCE_OTHER = 0.75
PACKAGE_LABEL = {"crates": "crates.io", "pypi": "PyPI", "npm": "npm"}
# Claim property -> role, label, confidence.
CLAIM_ROLE = {
    "P170": ("author", "creator", 0.9),
    "P112": ("author", "founder", 0.9),
    "P178": ("maintainer", "developer", 0.75),
}
# Roles a page grants on a handle match only, and roles that count most.
HANDLE_REQUIRED_ROLES = ["steering_council"]
HIGH_SIGNAL_ROLES = ["steering_council", "standards_author", "maintainer"]

# Evidence operators in the order that breaks ties between equal evidence.
EVIDENCE_ORDER = [
    "ownership", "codeowners", "maintainers", "manifests", "enhancement_proposals",
    "governance", "contributors", "subcomponents", "authors", "web_roles",
    "web_roles_auto", "packages", "curated", "wikidata", "wikipedia_authors",
    "release_manager", "founders",
]
