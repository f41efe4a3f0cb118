"""Names by which paths are told apart."""

from __future__ import annotations

# Folders, names, beginnings of names and extensions by kind of file. Each is part of the results.
VENDOR_FOLDERS = ("vendor", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "Pods", "Carthage", "site-packages", "jspm_packages", ".bundle")
OUTPUT_FOLDERS = (
    "target", "dist", "out", "obj", ".next", ".nuxt", ".svelte-kit", "__pycache__", "coverage", ".gradle", ".pytest_cache", ".mypy_cache",
    ".tox", "htmlcov", ".parcel-cache", ".turbo", ".angular", "DerivedData", ".dart_tool", ".output",
)
IDE_FOLDERS = (".idea", ".vscode", ".vs", ".fleet", ".settings", ".eclipse", ".zed")
IDE_FILES = (".project", ".classpath", ".factorypath", "Session.vim")
IDE_EXTENSIONS = ("iml", "suo", "user", "sublime-project", "sublime-workspace", "code-workspace")
GENERATED_FOLDERS = ("generated", "__generated__", "gen-src", "autogen")
GENERATED_ENDS = (
    ".pb.go", ".pb.cc", ".pb.h", "_pb2.py", "_pb2_grpc.py", "_pb2.pyi", ".pb.ts", "_pb.js", "_pb.d.ts", ".g.dart", ".freezed.dart",
    ".gr.dart", ".config.dart", ".gen.go", "_generated.go", ".designer.cs", ".g.cs", ".g.i.cs", ".min.js", ".min.css", ".min.mjs",
    ".bundle.js", ".chunk.js", ".js.map", ".css.map", ".d.ts.map", ".generated.ts", ".generated.js", ".generated.rs", "_generated.rs", ".pyc",
)
GENERATED_STARTS = ("zz_generated",)
LOCKFILES = (
    "Cargo.lock", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "deno.lock", "poetry.lock",
    "Pipfile.lock", "uv.lock", "pdm.lock", "composer.lock", "Gemfile.lock", "go.sum", "go.work.sum", "mix.lock", "pubspec.lock", "Podfile.lock",
    "packages.lock.json", "gradle.lockfile", "flake.lock", "Package.resolved", "conan.lock", "Cartfile.resolved", "shard.lock",
)
MANIFESTS = (
    "Cargo.toml", "package.json", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "requirements.txt", "requirements-dev.txt", "requirements_dev.txt",
    "dev-requirements.txt", "go.mod", "go.work", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
    "packages.config", "Directory.Packages.props", "composer.json", "Gemfile", "pubspec.yaml", "Package.swift", "Podfile", "Cartfile", "mix.exs",
    "deno.json", "deno.jsonc", "conanfile.txt", "conanfile.py", "vcpkg.json", "environment.yml", "environment.yaml", "pnpm-workspace.yaml",
    "lerna.json", "nx.json", "turbo.json", "rush.json", "shard.yml", "stack.yaml", "cabal.project", "dub.json", "Project.toml",
)
MANIFEST_EXTENSIONS = ("csproj", "fsproj", "vbproj", "gemspec", "cabal", "nimble")
CI_FOLDERS = (".circleci", ".buildkite", ".woodpecker")
CI_FILES = (
    ".gitlab-ci.yml", "Jenkinsfile", "azure-pipelines.yml", ".travis.yml", "bitbucket-pipelines.yml", ".drone.yml", "appveyor.yml", ".appveyor.yml",
    "cloudbuild.yaml", "cloudbuild.yml", "codemagic.yaml", ".woodpecker.yml", "buildspec.yml", ".cirrus.yml", "wercker.yml", "netlify.toml",
    "vercel.json", "render.yaml", "fly.toml",
)
WORKFLOW_FOLDERS = (".github/workflows/", ".gitea/workflows/", ".forgejo/workflows/")
CONTAINER_FILES = ("Dockerfile", "Containerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", ".dockerignore", "devcontainer.json")
INFRA_FOLDERS = ("terraform", "k8s", "kubernetes", "helm", "charts", "ansible", "pulumi", "manifests", "deploy", "deployment", "deployments", "infra", "infrastructure", "cloudformation")
INFRA_FILES = ("Chart.yaml", "kustomization.yaml", "kustomization.yml", "serverless.yml", "serverless.yaml", "cdk.json", "Pulumi.yaml", "skaffold.yaml", "Tiltfile", "app.yaml", "template.yaml")
INFRA_EXTENSIONS = ("tf", "tfvars", "hcl", "bicep", "nomad")
BUILD_FILES = (
    "Makefile", "makefile", "GNUmakefile", "CMakeLists.txt", "meson.build", "meson_options.txt", "BUILD", "BUILD.bazel", "WORKSPACE", "WORKSPACE.bazel",
    "MODULE.bazel", "SConstruct", "SConscript", "build.xml", "Rakefile", "justfile", "Justfile", "Taskfile.yml", "Taskfile.yaml", "gradlew", "gradlew.bat",
    "mvnw", "mvnw.cmd", "build.sbt", "Directory.Build.props", "Directory.Build.targets", "configure.ac", "Makefile.am", "build.zig", "Earthfile",
)
BUILD_STARTS = (
    "webpack.config.", "vite.config.", "vitest.config.", "rollup.config.", "gulpfile.", "Gruntfile.", "esbuild.config.", "tsup.config.", "babel.config.",
    "svelte.config.", "next.config.", "nuxt.config.", "astro.config.", "remix.config.", "metro.config.", "snowpack.config.", "craco.config.", "rspack.config.", "turbo.",
)
BUILD_EXTENSIONS = ("cmake", "bzl", "mk", "mak", "sln", "vcxproj", "pbxproj", "xcconfig")
LICENSE_STARTS = ("LICENSE", "LICENCE", "COPYING", "UNLICENSE", "NOTICE", "COPYRIGHT")
DOC_FOLDERS = ("docs", "doc", "documentation", "man", "wiki", "guides", "website", "site")
DOC_STARTS = (
    "README", "CHANGELOG", "CHANGES", "HISTORY", "NEWS", "CONTRIBUTING", "CODE_OF_CONDUCT", "SECURITY", "SUPPORT", "GOVERNANCE", "AUTHORS", "MAINTAINERS",
    "CONTRIBUTORS", "ROADMAP", "RELEASE", "UPGRADING", "MIGRATION", "FAQ", "ARCHITECTURE", "DESIGN", "CITATION",
)
DOC_EXTENSIONS = ("md", "markdown", "mdx", "rst", "adoc", "asciidoc", "txt", "pdf", "tex", "org", "pod")
CONFIG_FILES = (
    ".editorconfig", ".gitignore", ".gitattributes", ".gitmodules", ".mailmap", ".npmrc", ".nvmrc", ".node-version", ".python-version", ".ruby-version",
    ".tool-versions", ".yarnrc", ".yarnrc.yml", ".prettierrc", ".prettierignore", ".eslintignore", ".eslintrc", ".stylelintrc", ".babelrc", ".browserslistrc",
    ".env", ".env.example", ".flake8", ".pylintrc", ".rubocop.yml", ".golangci.yml", ".golangci.yaml", ".clang-format", ".clang-tidy",
    ".pre-commit-config.yaml", ".markdownlint.json", ".swiftlint.yml", "CODEOWNERS", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", "deny.toml",
    "rust-toolchain", "rust-toolchain.toml", "tsconfig.json", "jsconfig.json", "tox.ini", "pytest.ini", "mypy.ini", "renovate.json", ".renovaterc",
    "biome.json", ".swcrc", "codecov.yml", ".codecov.yml", "dependabot.yml", "Procfile", ".htaccess", "robots.txt", "tauri.conf.json",
)
CONFIG_STARTS = (
    ".eslintrc.", "eslint.config.", ".prettierrc.", "prettier.config.", "tsconfig.", ".stylelintrc.", "stylelint.config.", "jest.config.", "karma.conf.",
    "playwright.config.", "cypress.config.", "tailwind.config.", "postcss.config.", ".env.", "commitlint.config.", "lint-staged.config.", ".lintstagedrc",
    ".releaserc", "release.config.",
)
CONFIG_FOLDERS = ("config", "configs", "conf", ".config", "settings")
ASSET_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "icns", "webp", "svg", "tif", "tiff", "avif", "heic", "ttf", "otf", "woff", "woff2", "eot", "mp3", "wav",
    "ogg", "flac", "m4a", "aac", "mp4", "webm", "mov", "avi", "mkv", "obj", "fbx", "glb", "gltf", "blend", "psd", "ai", "sketch", "fig", "xd", "cur",
    "ani", "lottie", "riv",
)
DATA_EXTENSIONS = (
    "csv", "tsv", "psv", "parquet", "sqlite", "sqlite3", "db", "npy", "npz", "h5", "hdf5", "pkl", "pickle", "feather", "arrow", "avro", "orc", "jsonl",
    "ndjson", "geojson", "xlsx", "xls", "ods", "dat", "tfrecord", "safetensors", "onnx", "pt", "ckpt",
)
DATA_FOLDERS = ("data", "datasets", "dataset", "samples", "sample-data")
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "a", "lib", "o", "class", "jar", "war", "ear", "pyc", "pyo", "wasm", "zip", "tar", "gz", "tgz", "bz2", "xz", "7z", "rar",
    "zst", "iso", "dmg", "msi", "deb", "rpm", "apk", "aab", "ipa", "bin", "img", "pdb", "nupkg", "whl", "gem", "crx",
)
