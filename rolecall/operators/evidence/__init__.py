"""Evidence operators: one function per way a project records roles."""

from .base import Context, check_schema, emit, operators, register, registered

__all__ = ["Context", "check_schema", "emit", "operators", "register", "registered"]
