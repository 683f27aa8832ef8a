"""Column functions of the engine in one place."""

from ..model import null_if_nan, number
from ..operators.attributes import whole
from ..operators.catalog import id_of_file, id_of_uri, swapped_host, years_of
from ..operators.depth import depth_bin
from ..operators.extract import first_depth
from ..operators.qc import good
from ..sources.catalogs import script_json
from ..sources.files import digits_to_time, parse_time, resolution

__all__ = ["depth_bin", "digits_to_time", "first_depth", "good", "id_of_file", "id_of_uri", "null_if_nan", "number", "parse_time", "resolution", "script_json", "swapped_host", "whole", "years_of"]
