"""Column expressions: names, patterns, locators, flags, descriptors."""

from symlake.functions.descriptors import (
    descriptor_arity,
    explode_descriptor,
    param_types,
    render_field,
    render_method,
    render_signature,
    render_type,
    return_type,
    types_match,
)
from symlake.functions.filters import only_prefixes, prefix_rules, suspicious_name
from symlake.functions.flags import decode_flags, is_visible_field, is_visible_method, is_visible_inner, visible_members
from symlake.functions.locators import build_locator, parse_fragment, parse_locator
from symlake.functions.names import (
    display_package,
    innermost_name,
    package_name,
    package_of_source,
    qualified_name,
    simple_name,
    to_dotted,
    to_internal,
)
from symlake.functions.patterns import camel_match, find_regex, glob_match, glob_regex, scope_match
from symlake.functions.versions import java_release, release_features, release_label

__all__ = [
    "build_locator", "camel_match", "decode_flags", "descriptor_arity", "display_package",
    "explode_descriptor", "find_regex", "glob_match", "glob_regex", "innermost_name", "is_visible_field",
    "is_visible_inner", "is_visible_method", "java_release", "only_prefixes", "package_name", "package_of_source",
    "param_types", "parse_fragment", "parse_locator", "prefix_rules", "qualified_name", "release_features",
    "release_label", "render_field", "render_method", "render_signature", "render_type", "return_type",
    "scope_match", "simple_name", "suspicious_name", "to_dotted", "to_internal", "types_match", "visible_members",
]
