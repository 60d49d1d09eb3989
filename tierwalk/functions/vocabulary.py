"""Words of the data model: kinds of nodes and edges, tiers, and the sets of kinds that operators branch on."""

from __future__ import annotations

#: Strongest first.
TIERS = ("RESOLVED", "HEURISTIC", "DYNAMIC")
#: What counts as a caller, as inheritance, and what a walk of consequences follows.
CALLER_KINDS = ("CALLS", "NEW")
INHERIT_KINDS = ("EXTENDS", "IMPLEMENTS", "USES_TRAIT")
IMPACT_KINDS = ("CALLS", "NEW", "EXTENDS", "IMPLEMENTS", "INCLUDES", "IMPORTS")
#: Weight of a kind in a blast radius, loss per hop, and the score below which a name is not listed.
IMPACT_WEIGHTS = {"CALLS": 1.0, "NEW": 1.0, "EXTENDS": 0.9, "IMPLEMENTS": 0.9, "INCLUDES": 0.8, "IMPORTS": 0.8}
DECAY, FLOOR = 0.7, 0.05
#: Kinds that operators branch on.
TYPE_KINDS = ("Class", "Interface", "Trait", "Enum")
FLOW_KINDS = (*IMPACT_KINDS, "WRITES")
TEST_KINDS = ("CALLS", "NEW", "REFERENCES", "IMPORTS")
#: Gates for mirrored subtrees and for module containers.
MIRROR_SHARED, MIRROR_OVERLAP = 25, 0.30
MODULE_FILES, MODULE_COUNT = 3, 4
MEMBER = "::"
#: Fixed values of linking: kinds linked by name and by path, kinds whose dynamic edges are linked too, kinds that act on
#: tables, what counts as an object of a schema, the mark of a member's declared type, longest chain, widest fan of subtypes.
FQN_KINDS = ("EXTENDS", "IMPLEMENTS", "USES_TRAIT", "CALLS", "NEW", "ALIASES", "REFERENCES", "WRITES", "ALTERS", "DELETES", "READS")
PATH_KINDS = ("INCLUDES", "IMPORTS")
DYNAMIC_LINKED = ("REFERENCES", "ALTERS")
SCHEMA_KINDS = ("WRITES", "ALTERS")
SCHEMA_OBJECTS = ("Table", "Column", "View")
TYPE_OF, CHAIN_STEPS, SUBTYPES = "()", 8, 64
#: Crumbs of names that say nothing, and the least length of a word of a name.
TOKEN_STOP, TOKEN_LENGTH = ("get", "set", "new", "add", "the", "and", "for", "with", "from"), 4
#: Words of path segments and the responsibility they name, in the order of reading; what is read last.
RESPONSIBILITIES = (
    ("HTTP / Entry", ("controller", "handler", "route", "endpoint", "api")),
    ("Services", ("service", "usecase")),
    ("Domain / Data", ("model", "entity", "repository")),
    ("Views", ("view", "template", "page", "form")),
    ("Middleware / Auth", ("middleware", "filter", "auth", "session")),
    ("Background Jobs", ("job", "cron", "queue", "worker")),
    ("Integration / Reporting", ("report", "export", "integration")),
    ("Shared Library", ("lib", "util", "helper", "common", "system")),
    ("Tests", ("test", "spec", "mock")),
    ("Config / Migration", ("config", "migration")),
    ("Vendor / Framework", ("vendor",)),
)
READ_LATE = ("Tests", "Config / Migration", "Vendor / Framework")
READ_LAST_ANYWHERE = ("Tests", "Vendor / Framework")
WEB_ROOTS = ("public", "www", "htdocs")
UNCATEGORISED, ROOT_LAYER = "Uncategorised", "(root)"
BANDS = ("source", "mixed", "sink", "isolated")
