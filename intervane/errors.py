"""Exceptions of the library."""


class NoData(ValueError):
    """Nothing to work on."""


class MissingData(ValueError):
    """Some parts of a result are absent."""


class BEDFormatError(ValueError):
    """A line does not have the columns of an interval file."""


class NotARegion(ValueError):
    """A text is not a region like ``chr1:1,000-2,000``."""


class BarcodeError(ValueError):
    """A file name carries no barcode."""


class BadCovariance(ValueError):
    """A covariance expression is not understood."""


class ArgumentError(ValueError):
    """A parameter is outside its range."""


class RegionTooSmall(ValueError):
    """A region is too short to be divided."""


class InvalidRegionBounds(ValueError):
    """A region does not hold the events it should."""
