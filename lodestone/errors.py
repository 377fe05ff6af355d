"""Exceptions; all are subclasses of DatabaseError."""


class DatabaseError(Exception):
    pass


class SchemaError(DatabaseError):
    pass


class EntryValidationError(DatabaseError):
    pass


class CheckConstraintError(DatabaseError):
    def __init__(self, name: str):
        super().__init__(f"check constraint {name} is violated")
        self.name = name


class ForeignKeyError(DatabaseError):
    def __init__(self, name: str, why: str = "is violated"):
        super().__init__(f"foreign key {name} {why}")
        self.name = name
