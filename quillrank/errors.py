"""What can go wrong, one class for each kind, all of them ``QuillError``."""


class QuillError(Exception):
    """The base of this package's errors."""


class InvalidParameter(QuillError, ValueError):
    """A scoring parameter, k or block size outside its range, or an unknown method."""


class TokenizationError(QuillError, ValueError):
    """A token pattern that isn't a regular expression."""


class EmptyCorpus(QuillError, ValueError):
    """An index of no documents, or a compaction that would leave none."""


class InvalidDocument(QuillError, ValueError):
    """An input file whose rows don't have the field asked for."""


class CorruptIndex(QuillError):
    """A stored index whose files don't agree with its manifest."""


class UnsupportedVersion(CorruptIndex):
    """A stored index of another format version."""


class Truncated(CorruptIndex):
    """A stored index of which a file is missing or cut off."""


class ChecksumMismatch(CorruptIndex):
    """A stored table whose rows aren't those that were saved."""


class NotBuilt(QuillError):
    """A search before there is an index."""


class FeatureNotEnabled(QuillError):
    """Something that the index wasn't prepared for, as approximate search without bounds."""


class SerializationError(QuillError, ValueError):
    """A report or a request that isn't the JSON that it should be."""


class HubError(QuillError):
    """Sending to or fetching from a hub, which needs a network."""


class LogState(QuillError):
    """An update log used out of turn: not initialised, or a commit without a batch."""


class ShardFailure(QuillError):
    """No shard gave an answer."""
