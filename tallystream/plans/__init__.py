"""The registered queries; importing the package registers all of them."""

from tallystream.plans import catalogue, relational, services  # noqa: F401
