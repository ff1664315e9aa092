"""Expected failures; the command line reports them with exit code 2."""


class NotegraphError(Exception):
    code = "error"


class ManifestError(NotegraphError):
    code = "manifest"


class ParseError(NotegraphError):
    code = "markdown"


class QueryError(NotegraphError):
    code = "query"


class IndexStoreError(NotegraphError):
    code = "index"


class MergeError(NotegraphError):
    code = "merge"


class MutationError(NotegraphError):
    code = "mutation"
