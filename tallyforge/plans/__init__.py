"""Named queries; importing the package registers them all."""

from . import binaries, chains, documents, inventory, joins, projects, readers, scalars  # noqa: F401
