"""Graph queries by name. The further ones register themselves beside those of the catalogue."""

from tierwalk.plans import further  # noqa: F401
