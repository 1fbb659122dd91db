"""What the engine raises."""


class InvalidQueryError(ValueError):
    """A query that can't be answered: which field, which value, and why."""

    def __init__(self, field: str, value: object, message: str):
        super().__init__(message)
        self.field, self.value = field, value


class JobNotFoundError(LookupError):
    def __init__(self, job_id: str):
        super().__init__(f"no job {job_id!r}")
        self.job_id = job_id


class InvalidFileTypeError(ValueError):
    pass


class FileTooLargeError(ValueError):
    pass


class LogProcessingError(RuntimeError):
    pass
