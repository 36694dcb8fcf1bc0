"""Catalogues that are known in advance: names, targets and descriptions."""

from __future__ import annotations

# Utilities of the suite: name, settings page, article, description, merged with a program of its own.
SUITE_UTILITIES = (
    ("Advanced Paste", "AdvancedPaste", "advanced-paste", "Paste clipboard content in another format or transform it with AI.", False),
    ("Always on Top", "AlwaysOnTop", "always-on-top", "Pin a window above every other window.", False),
    ("Awake", "Awake", "awake", "Keep the computer awake without changing its power settings.", False),
    ("Color Picker", "ColorPicker", "color-picker", "Pick a color from anywhere on the screen and copy it in a configurable format.", False),
    ("Command Not Found", "CommandNotFound", "cmd-not-found", "Suggest a WinGet package when a PowerShell command is not installed.", False),
    ("Command Palette", "CmdPal", "command-palette/overview", "Search, launch, and control applications and commands from a customizable palette.", True),
    ("Crop And Lock", "CropAndLock", "crop-and-lock", "Create a cropped view or interactive thumbnail of another window.", False),
    ("Cursor Wrap", "MouseUtils", "mouse-utilities", "Wrap the mouse pointer across screen edges.", False),
    ("Environment Variables", "EnvironmentVariables", "environment-variables", "Create and manage user and system environment variable profiles.", False),
    ("FancyZones", "FancyZones", "fancyzones", "Create window layouts and quickly arrange windows into zones.", False),
    ("File Explorer add-ons", "FileExplorer", "file-explorer", "Add previews and thumbnails for developer and document file formats.", False),
    ("File Locksmith", "FileLocksmith", "file-locksmith", "Find which processes are using a file or directory.", False),
    ("Hosts File Editor", "Hosts", "hosts-file-editor", "Edit the Windows hosts file.", False),
    ("Image Resizer", "ImageResizer", "image-resizer", "Resize one or more images from File Explorer.", False),
    ("Keyboard Manager", "KeyboardManager", "keyboard-manager", "Remap keys and keyboard shortcuts.", False),
    ("Light Switch", "LightSwitch", "light-switch", "Switch Windows between light and dark themes on a schedule.", False),
    ("Find My Mouse", "MouseUtils", "mouse-utilities", "Locate the mouse pointer with a visual spotlight.", False),
    ("Mouse Highlighter", "MouseUtils", "mouse-utilities", "Show visual indicators when mouse buttons are clicked.", False),
    ("Mouse Jump", "MouseUtils", "mouse-utilities", "Move the pointer long distances using a screen preview.", False),
    ("Mouse Pointer Crosshairs", "MouseUtils", "mouse-utilities", "Draw crosshairs centered on the mouse pointer.", False),
    ("Mouse Without Borders", "MouseWithoutBorders", "mouse-without-borders", "Control multiple computers with one keyboard and mouse.", False),
    ("New+", "NewPlus", "newplus", "Create files and folders from personalized templates.", False),
    ("Peek", "Peek", "peek", "Preview a file without opening its application.", False),
    ("PowerRename", "PowerRename", "powerrename", "Rename many files with search, replacement, and regular expressions.", False),
    ("PowerToys Run", "PowerLauncher", "run", "Quickly search for and launch applications, files, folders, and commands.", False),
    ("Quick Accent", "QuickAccent", "quick-accent", "Type accented characters from a popup selector.", False),
    ("Registry Preview", "RegistryPreview", "registry-preview", "Preview and edit Windows Registry files.", False),
    ("Screen Ruler", "MeasureTool", "screen-ruler", "Measure pixels on the screen using image edge detection.", False),
    ("Shortcut Guide", "ShortcutGuide", "shortcut-guide", "Show an overlay of available Windows-key shortcuts.", False),
    ("Text Extractor", "PowerOcr", "text-extractor", "Copy text from anywhere on the screen using optical character recognition.", False),
    ("Workspaces", "Workspaces", "workspaces", "Launch applications into saved desktop layouts.", False),
    ("ZoomIt", "ZoomIt", "zoomit", "Zoom, annotate, and record the screen during presentations.", False),
)
# Pages of the settings: name, address, description.
SETTINGS_PAGES = (
    ("Display", "ms-settings:display", "Change monitor layout, brightness, scale, resolution, and advanced display settings."),
    ("Scale", "ms-settings:display-advanced", "Review advanced display details and related scaling options."),
    ("Night Light", "ms-settings:nightlight", "Reduce blue light and schedule warmer display colors at night."),
    ("Sound", "ms-settings:sound", "Manage volume, output, input, and sound device settings."),
    ("Volume Mixer", "ms-settings:apps-volume", "Set per-app volume levels and audio input or output devices."),
    ("Sound Output Devices", "ms-settings:sound-devices", "Manage speakers, headphones, microphones, and other sound devices."),
    ("Notifications", "ms-settings:notifications", "Control app notifications, banners, sounds, and notification center behavior."),
    ("Focus Assist", "ms-settings:quiethours", "Reduce distractions by controlling focus and do-not-disturb rules."),
    ("Power & Battery", "ms-settings:powersleep", "Manage power mode, battery usage, and sleep settings."),
    ("Battery Saver", "ms-settings:batterysaver", "Configure battery saver and power-saving behavior."),
    ("Storage", "ms-settings:storagesense", "View disk usage and manage storage across apps, files, and drives."),
    ("Storage Sense", "ms-settings:storagepolicies", "Automatically clean temporary files, recycle bin, and cloud-backed content."),
    ("Disk Cleanup Recommendations", "ms-settings:storagerecommendations", "Find cleanup recommendations for temporary files, large files, and unused apps."),
    ("Nearby Sharing", "ms-settings:crossdevice", "Share files and links with nearby Windows devices."),
    ("Multitasking", "ms-settings:multitasking", "Configure snap windows, desktops, Alt+Tab, and multitasking behavior."),
    ("Activation", "ms-settings:activation", "Check Windows activation status and change product key."),
    ("Troubleshoot", "ms-settings:troubleshoot", "Find and run troubleshooters for common Windows problems."),
    ("Other Troubleshooters", "ms-settings:troubleshoot-other", "Run individual troubleshooters for network, audio, printer, update, and more."),
    ("Recovery", "ms-settings:recovery", "Reset this PC, advanced startup, and recovery options."),
    ("Projecting to This PC", "ms-settings:project", "Configure wireless projection and Miracast receiving settings."),
    ("Remote Desktop", "ms-settings:remotedesktop", "Enable and configure Remote Desktop access to this PC."),
    ("Clipboard", "ms-settings:clipboard", "Manage clipboard history, sync, and suggested actions."),
    ("Bluetooth & Devices", "ms-settings:bluetooth", "Manage Bluetooth, paired devices, and device discovery."),
    ("Devices", "ms-settings:connecteddevices", "Manage connected peripherals and wireless displays."),
    ("Printers & Scanners", "ms-settings:printers", "Add, remove, and manage printers, scanners, queues, and preferences."),
    ("Mouse", "ms-settings:mousetouchpad", "Adjust mouse buttons, pointer speed, wheel, and related pointer settings."),
    ("Touchpad", "ms-settings:devices-touchpad", "Configure touchpad gestures, taps, sensitivity, and scrolling."),
    ("Pen & Windows Ink", "ms-settings:pen", "Configure pen shortcuts, handwriting, and Windows Ink behavior."),
    ("AutoPlay", "ms-settings:autoplay", "Choose default actions for removable drives, memory cards, and devices."),
    ("USB", "ms-settings:usb", "Manage USB connection notifications and battery saver behavior."),
    ("Phone Link", "ms-settings:mobile-devices", "Manage mobile device connections and Phone Link integration."),
    ("Network Status", "ms-settings:network-status", "View network connection status and network troubleshooting entry points."),
    ("Wi-Fi", "ms-settings:network-wifi", "Manage Wi-Fi networks, adapters, and wireless properties."),
    ("Ethernet", "ms-settings:network-ethernet", "Manage wired network adapters and Ethernet connection properties."),
    ("VPN", "ms-settings:network-vpn", "Add, remove, and connect VPN profiles."),
    ("Airplane Mode", "ms-settings:network-airplanemode", "Turn airplane mode and wireless radios on or off."),
    ("Mobile Hotspot", "ms-settings:network-mobilehotspot", "Share this PC's internet connection as a hotspot."),
    ("Proxy", "ms-settings:network-proxy", "Configure automatic and manual proxy server settings."),
    ("Dial-up", "ms-settings:network-dialup", "Set up and manage dial-up network connections."),
    ("Personalization", "ms-settings:personalization", "Customize Windows appearance, themes, background, and colors."),
    ("Background", "ms-settings:personalization-background", "Change desktop wallpaper, slideshow, and background fit."),
    ("Colors", "ms-settings:personalization-colors", "Choose light or dark mode, accent color, and transparency effects."),
    ("Themes", "ms-settings:themes", "Select, save, and manage Windows themes."),
    ("Lock Screen", "ms-settings:lockscreen", "Customize lock screen background, status apps, and sign-in screen image."),
    ("Start", "ms-settings:personalization-start", "Configure Start menu layout, recommendations, and folders."),
    ("Taskbar", "ms-settings:taskbar", "Customize taskbar alignment, icons, behaviors, and system tray."),
    ("Fonts", "ms-settings:fonts", "Preview, install, and manage fonts."),
    ("Installed Apps", "ms-settings:appsfeatures", "Uninstall, move, reset, and manage installed applications."),
    ("Default Apps", "ms-settings:defaultapps", "Choose default apps by file type, protocol, or application."),
    ("Optional Features", "ms-settings:optionalfeatures", "Add, remove, and manage Windows optional features."),
    ("Startup Apps", "ms-settings:startupapps", "Choose which apps start automatically when signing in."),
    ("Accounts", "ms-settings:accounts", "Manage user accounts, Microsoft account, work access, and sign-in settings."),
    ("Your Info", "ms-settings:yourinfo", "View and manage account picture and local or Microsoft account information."),
    ("Email & Accounts", "ms-settings:emailandaccounts", "Manage accounts used by email, calendar, contacts, and apps."),
    ("Sign-in Options", "ms-settings:signinoptions", "Configure password, PIN, fingerprint, face, security key, and dynamic lock."),
    ("Windows Hello Face", "ms-settings:signinoptions-launchfaceenrollment", "Start Windows Hello face recognition setup."),
    ("Family", "ms-settings:family-group", "Manage family members, parental controls, and family safety settings."),
    ("Other Users", "ms-settings:otherusers", "Add and manage local users, guests, and kiosk access."),
    ("Windows Backup", "ms-settings:backup", "Back up files, apps, preferences, and credentials to your Microsoft account."),
    ("Date & Time", "ms-settings:dateandtime", "Set time zone, clock, automatic time, and additional clocks."),
    ("Region", "ms-settings:regionformatting", "Choose country, regional format, and locale formats."),
    ("Language", "ms-settings:regionlanguage", "Add languages and configure Windows display language."),
    ("Typing", "ms-settings:typing", "Configure typing suggestions, autocorrect, touch keyboard, and hardware keyboard options."),
    ("Speech", "ms-settings:speech", "Manage speech language, voice recognition, and text-to-speech voices."),
    ("Xbox Game Bar", "ms-settings:gaming-gamebar", "Configure Xbox Game Bar shortcuts, capture controls, and widgets."),
    ("Game Mode", "ms-settings:gaming-gamemode", "Optimize Windows for gameplay and game performance."),
    ("Text Size", "ms-settings:easeofaccess-display", "Increase text size and adjust display accessibility options."),
    ("Visual Effects", "ms-settings:easeofaccess-visualeffects", "Configure animations, transparency, scrollbars, and notification timing."),
    ("Mouse Pointer", "ms-settings:easeofaccess-mousepointer", "Change mouse pointer size, color, and touch feedback."),
    ("Magnifier", "ms-settings:easeofaccess-magnifier", "Zoom the screen and configure Magnifier reading and tracking."),
    ("Color Filters", "ms-settings:easeofaccess-colorfilter", "Apply color filters for color blindness or visual comfort."),
    ("Contrast Themes", "ms-settings:easeofaccess-highcontrast", "Use high contrast themes for improved readability."),
    ("Narrator", "ms-settings:easeofaccess-narrator", "Configure the built-in screen reader and voice settings."),
    ("Accessibility Audio", "ms-settings:easeofaccess-audio", "Make audio easier to hear and show audio alerts visually."),
    ("Captions", "ms-settings:easeofaccess-closedcaptioning", "Customize caption style for videos and system captions."),
    ("Windows Speech Recognition", "ms-settings:easeofaccess-speechrecognition", "Control Windows with speech recognition."),
    ("Eye Control", "ms-settings:easeofaccess-eyecontrol", "Configure eye tracking control for supported devices."),
    ("Privacy & Security", "ms-settings:privacy", "Manage privacy permissions, security settings, and diagnostic controls."),
    ("Windows Security", "ms-settings:windowsdefender", "Open virus protection, firewall, account, device, and app security status."),
    ("Find My Device", "ms-settings:findmydevice", "Locate this device and manage find-my-device settings."),
    ("For Developers", "ms-settings:developers", "Enable developer mode, device portal, and development-related settings."),
    ("Device Encryption", "ms-settings:deviceencryption", "View and manage device encryption when supported by hardware."),
    ("BitLocker", "ms-settings:privacy-deviceencryption", "Review encryption and BitLocker-related device protection settings."),
    ("Location Privacy", "ms-settings:privacy-location", "Control location access for Windows, apps, and services."),
    ("Camera Privacy", "ms-settings:privacy-webcam", "Control camera access for apps and Windows features."),
    ("Microphone Privacy", "ms-settings:privacy-microphone", "Control microphone access for apps and Windows features."),
    ("Windows Update", "ms-settings:windowsupdate", "Check for updates and manage Windows Update status."),
    ("Update History", "ms-settings:windowsupdate-history", "View installed quality, driver, definition, and feature updates."),
    ("Advanced Windows Update Options", "ms-settings:windowsupdate-options", "Configure active hours, optional updates, restart options, and update policies."),
    ("Windows Insider Program", "ms-settings:windowsinsider", "Join or manage Windows Insider preview builds."),
    ("Delivery Optimization", "ms-settings:delivery-optimization", "Control update downloads from Microsoft, local network, or internet peers."),
)
# Tools of the system: file, name, description.
SYSTEM_TOOLS = (
    ("ipconfig.exe", "IP Configuration", "Display and refresh IP network configuration."),
    ("ping.exe", "Ping", "Test network reachability and latency to a host."),
    ("tracert.exe", "Trace Route", "Trace the network path packets take to a destination."),
    ("netstat.exe", "Netstat", "Show active network connections, ports, and protocol statistics."),
    ("nslookup.exe", "NSLookup", "Query DNS records and troubleshoot name resolution."),
    ("route.exe", "Route", "View and modify the IP routing table."),
    ("arp.exe", "ARP", "Display and modify the address resolution protocol cache."),
    ("netsh.exe", "Netsh", "Configure network components from the command line."),
    ("sfc.exe", "System File Checker", "Scan and repair protected Windows system files."),
    ("dism.exe", "Deployment Image Servicing and Management", "Service Windows images, features, packages, and component store health."),
    ("chkdsk.exe", "Check Disk", "Check a volume for file system and disk errors."),
    ("diskpart.exe", "DiskPart", "Manage disks, partitions, and volumes."),
    ("tasklist.exe", "Tasklist", "List running processes and services."),
    ("taskkill.exe", "Taskkill", "Terminate processes by process id or image name."),
    ("systeminfo.exe", "System Information", "Display operating system, hardware, hotfix, and configuration details."),
    ("whoami.exe", "Whoami", "Show the current user, groups, and privileges."),
    ("gpupdate.exe", "Group Policy Update", "Refresh local and domain Group Policy settings."),
    ("gpresult.exe", "Group Policy Result", "Report applied Group Policy settings for a user or computer."),
    ("robocopy.exe", "Robocopy", "Robustly copy files and directory trees."),
    ("xcopy.exe", "Xcopy", "Copy files and directory trees with legacy options."),
    ("schtasks.exe", "Scheduled Tasks", "Create, query, change, run, and delete scheduled tasks."),
    ("sc.exe", "Service Control", "Query, configure, start, and stop Windows services."),
    ("reg.exe", "Registry Console Tool", "Query and modify the Windows registry from the command line."),
    ("bcdedit.exe", "Boot Configuration Data Editor", "View and modify boot configuration data."),
    ("powercfg.exe", "Power Configuration", "Manage power plans, sleep, hibernate, and battery reports."),
    ("wmic.exe", "Windows Management Instrumentation Command-line", "Query WMI information using the legacy WMIC tool."),
    ("driverquery.exe", "Driver Query", "List installed device drivers and driver properties."),
    ("pathping.exe", "PathPing", "Combine ping and route tracing with packet loss statistics."),
    ("telnet.exe", "Telnet Client", "Open a Telnet connection when the optional client is installed."),
    ("ftp.exe", "FTP Client", "Transfer files with the built-in command-line FTP client."),
    ("certutil.exe", "Certificate Utility", "Manage certificates, encode files, hash files, and troubleshoot PKI."),
    ("cipher.exe", "Cipher", "Manage EFS encryption and securely wipe free space."),
    ("compact.exe", "Compact", "Show or change NTFS file compression."),
    ("fsutil.exe", "File System Utility", "Query and configure advanced file system settings."),
    ("icacls.exe", "ICACLS", "View and modify file and folder access control lists."),
    ("takeown.exe", "Take Ownership", "Take ownership of files or folders."),
    ("shutdown.exe", "Shutdown", "Shut down, restart, sign out, or hibernate the computer."),
    ("msinfo32.exe", "System Information", "Open the graphical System Information utility."),
    ("resmon.exe", "Resource Monitor", "Open Resource Monitor for CPU, memory, disk, and network activity."),
    ("perfmon.exe", "Performance Monitor", "Open Performance Monitor for counters and data collector sets."),
    ("cleanmgr.exe", "Disk Cleanup", "Free disk space by removing temporary and unnecessary files."),
    ("mstsc.exe", "Remote Desktop Connection", "Connect to another computer using Remote Desktop."),
    ("mrt.exe", "Malicious Software Removal Tool", "Run Microsoft's malware removal scanner."),
    ("dxdiag.exe", "DirectX Diagnostic Tool", "Show DirectX, display, sound, and input diagnostics."),
    ("regedit.exe", "Registry Editor", "Open the graphical Windows Registry Editor."),
    ("cmd.exe", "Command Prompt", "Open the classic Windows command interpreter."),
    ("powershell.exe", "Windows PowerShell", "Open Windows PowerShell for scripting and automation."),
    ("wt.exe", "Windows Terminal", "Open Windows Terminal."),
)
# Names of control panel applets and consoles by file.
CONTROL_NAMES = {
    "appwiz.cpl": "Programs and Features",
    "bthprops.cpl": "Bluetooth Devices",
    "desk.cpl": "Display Settings",
    "firewall.cpl": "Windows Defender Firewall",
    "hdwwiz.cpl": "Add Hardware",
    "inetcpl.cpl": "Internet Properties",
    "intl.cpl": "Region",
    "irprops.cpl": "Infrared",
    "joy.cpl": "Game Controllers",
    "main.cpl": "Mouse Properties",
    "mmsys.cpl": "Sound",
    "ncpa.cpl": "Network Connections",
    "powercfg.cpl": "Power Options",
    "sysdm.cpl": "System Properties",
    "tabletpc.cpl": "Tablet PC Settings",
    "telephon.cpl": "Phone and Modem",
    "timedate.cpl": "Date and Time",
    "wscui.cpl": "Security and Maintenance",
    "compmgmt.msc": "Computer Management",
    "devmgmt.msc": "Device Manager",
    "diskmgmt.msc": "Disk Management",
    "eventvwr.msc": "Event Viewer",
    "gpedit.msc": "Local Group Policy Editor",
    "lusrmgr.msc": "Local Users and Groups",
    "perfmon.msc": "Performance Monitor",
    "printmanagement.msc": "Print Management",
    "rsop.msc": "Resultant Set of Policy",
    "secpol.msc": "Local Security Policy",
    "services.msc": "Services",
    "taskschd.msc": "Task Scheduler",
    "wf.msc": "Windows Defender Firewall with Advanced Security",
    "wmimgmt.msc": "WMI Control",
}
