"""Errors of the engine."""


class TrellisError(Exception):
    pass


class NodeNotFoundError(TrellisError):
    pass


class RelationshipNotFoundError(TrellisError):
    pass


class InvalidLabelError(TrellisError):
    pass


class InvalidPropertyError(TrellisError):
    pass


class InvalidFilterError(TrellisError):
    pass


class ConstraintError(TrellisError):
    pass


class CypherError(TrellisError):
    pass


class CypherSyntaxError(CypherError):
    def __init__(self, message: str, line: int = 0, column: int = 0) -> None:
        super().__init__(f"{message} (line {line}, column {column})" if line else message)
        self.line, self.column = line, column


class CypherExecutionError(CypherError):
    pass
