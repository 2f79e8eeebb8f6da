"""Table schemas shared by sources, operators and tests."""

ENTRIES = (
    "container string, root_container string, container_type string, entry_path string, parent_path string, "
    "is_dir boolean, length bigint, depth int, content binary, error string"
)
POSTINGS = "index_name string, key string, container string, entry_path string"
SUPERTYPES = "container string, type_name string, super_name string, kind string"
TYPES = (
    "container string, entry_path string, type_name string, super_name string, outer_name string, "
    "inner_name string, flags int, major int, minor int"
)
MEMBERS = "container string, type_name string, kind string, name string, descriptor string, flags int"
INNER_CLASSES = "container string, entry_path string, inner_name string, outer_name string, simple string, flags int"

# Names of the symbol indexes.
TYPE_DECLARATIONS = "typeDeclarations"
TYPE_REFERENCES = "typeReferences"
CONSTRUCTOR_DECLARATIONS = "constructorDeclarations"
CONSTRUCTOR_REFERENCES = "constructorReferences"
METHOD_DECLARATIONS = "methodDeclarations"
METHOD_REFERENCES = "methodReferences"
FIELD_DECLARATIONS = "fieldDeclarations"
FIELD_REFERENCES = "fieldReferences"
STRINGS = "strings"
TEXTS = "texts"
MODULE_DECLARATIONS = "javaModuleDeclarations"
MODULE_REFERENCES = "javaModuleReferences"
PACKAGE_DECLARATIONS = "packageDeclarations"

# What a symbol search looks for.
SEARCH_TYPE = 1
SEARCH_CONSTRUCTOR = 2
SEARCH_METHOD = 4
SEARCH_FIELD = 8
SEARCH_STRING = 16
SEARCH_MODULE = 32
SEARCH_DECLARATION = 64
SEARCH_REFERENCE = 128
